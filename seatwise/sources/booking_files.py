"""Bookings laid out by date: one folder per reservation date, so that a question about a day opens the files of two days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def write_bookings(reservations: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Writes a new table of bookings in folders by date, sorted by venue inside. A date's rows are dealt over tasks by venue, so no
    task holds a whole busy date and a date has no more files than it needs."""
    (reservations.repartition("reservation_date", F.pmod(F.xxhash64("venue_id"), F.lit(8)))
     .sortWithinPartitions("reservation_date", "venue_id", "reservation_min")
     .write.option("maxRecordsPerFile", rows_per_file).partitionBy("reservation_date").parquet(path))


def read_bookings(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The bookings of ``path``; with ``schema`` no file is opened to learn it."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    table = reader.parquet(path)
    return table.withColumn("reservation_date", F.col("reservation_date").cast("date"))
