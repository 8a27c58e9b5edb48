"""Menu and venue files: CSV with a header and ``|``-separated lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from seatwise.functions.scalars import pipe_list

COLUMNS = {
    "food": "id section name description price_thb service allergens diet spicy contains available available_from available_to notes",
    "drink": "id section name description price_thb unit allergens contains available notes",
}
LISTS = ["service", "allergens", "diet", "contains"]


def _csv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns.split()])
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True).fillna("")


def parse_lists(raw: DataFrame) -> DataFrame:
    """List columns as arrays without empties."""
    return raw.withColumns({c: pipe_list(F.col(c)) for c in LISTS if c in raw.columns})


def read_menu(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One menu file (``food`` or ``drink``), lists parsed, everything else as written."""
    return parse_lists(_csv(spark, path, COLUMNS[kind]))


def read_venue(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, "key value")


def venue_facts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Key/value rows as one map per venue; a later duplicate of a key does not occur in a well-formed file."""
    return rows.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("facts"))


def replace_table(df: DataFrame, path: str) -> None:
    """Replaces a table's files in place. Who reads meanwhile may find none: where that matters, publish versions (``sources.versions``)."""
    df.write.mode("overwrite").parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
