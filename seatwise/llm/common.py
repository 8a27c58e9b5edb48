"""What several operators share: written tables, running totals over hot keys, batches of texts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where none is named, a new local one, but only in a local session (tests): on a
    cluster every machine would write to a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seatwise-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The rows of ``df`` from a Parquet table in the shared folder, in a folder for each value of ``by``: lineage ends there, lost
    executors lose nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(by) or None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def running(df: DataFrame, keys: list[str], sums: dict[str, str], order: list[str], bucket: Column | None = None) -> DataFrame:
    """Adds, for each ``new: column`` of ``sums``, the sum of the column over the earlier rows of the same key.

    No key is gathered in one task. Rows are dealt over buckets (by a hash of ``order`` unless ``bucket`` is given), each bucket is
    summed, and a row's running total is its bucket's start plus the total inside the bucket. The order of a key's rows is (bucket,
    ``order``); rows that tie in all of ``order`` share whatever place they get. Keys must not be null.
    """
    parts = max(64, shuffle_partitions(df.sparkSession))
    dealt = df.withColumn("_bucket", bucket if bucket is not None else F.pmod(F.xxhash64(*order), F.lit(parts)))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (dealt.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_{new}") for new, c in sums.items()])
              .select(*keys, "_bucket", *[F.coalesce(F.sum(f"_{new}").over(earlier), F.lit(0)).alias(f"_{new}") for new in sums]))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (dealt.join(starts, [*keys, "_bucket"])
            .select(*df.columns, *[(F.col(f"_{new}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(new)
                                   for new, c in sums.items()]))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out a single time, however often it is used: as a lambda's argument."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def batches_of(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch whose texts have about ``most`` bytes; a longer text makes a slice of its own."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + (size or 0) > most:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size or 0
    if first < len(sizes):
        yield batch.slice(first)
