"""Trailing counts and exact ranks whose window partitions stay bounded however hot a key is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seatwise.session import spread


def rolling(points: DataFrame, events: DataFrame, keys: list[str], horizon: int, out: str, point_epoch: str, event_epoch: str,
            per_second: Column, merge, rest=None) -> DataFrame:
    """For each distinct (keys, epoch) of ``points``: events of the same keys in the last ``horizon`` seconds, aggregated.

    An event counts when ``point - horizon < event <= point``. Time is cut into buckets one horizon long, so the span of a
    point is the end of one bucket and the beginning of the next. Events are first aggregated per key and second (map-side);
    a running aggregate forwards through each (key, bucket) gives a point its one part; the other is ``rest(whole bucket, part up
    to there)`` where the aggregate can be taken back, else a second running aggregate backwards. A window
    sorts at most three rows per second of one bucket, never a whole key, and takes constant time per row, where a sliding
    frame would go through its span again for every row. The rows are narrow and compress well, but sorting them takes many times
    their shuffled bytes, so they go to all shuffle partitions.
    """
    at = [F.col(k) for k in keys]
    bucket = F.floor(F.col("epoch") / horizon).alias("bucket")
    counted = events.withColumn("epoch", F.col(event_epoch)).where(F.col("epoch").isNotNull()).groupBy(*keys, "epoch").agg(
        per_second.cast("long").alias("n")).select(*at, "epoch", bucket, "n", F.lit(0).alias("probe"))
    asked = points.select(*at, F.col(point_epoch).cast("long").alias("asked")).where(F.col("asked").isNotNull()).distinct()
    probes = asked.select(*at, F.explode(F.array(
        F.struct(F.col("asked").alias("epoch"), F.lit(1).alias("probe")),
        F.struct((F.col("asked") - horizon).alias("epoch"), F.lit(2).alias("probe")))).alias("p")).select(
        *at, F.col("p.epoch").alias("epoch"), "p.probe").select(
        *at, "epoch", bucket, F.lit(None).cast("long").alias("n"), "probe")
    part = Window.partitionBy(*keys, "bucket")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    forwards = part.orderBy("epoch", "probe")  # a probe comes after the events of its second
    upto = merge("n").over(forwards.rowsBetween(*so_far))
    if rest is None:
        after = merge("n").over(part.orderBy(F.col("epoch").desc(), F.col("probe").desc()).rowsBetween(*so_far))
    else:
        whole = merge("n").over(forwards.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        after = rest(whole, F.coalesce(upto, F.lit(0)))
    return (
        spread(counted.unionByName(probes), *keys, "bucket")
        .withColumns({"upto": upto, "after": after})
        .where("probe > 0")
        .groupBy(*keys, F.when(F.col("probe") == 1, F.col("epoch")).otherwise(F.col("epoch") + horizon).alias(point_epoch))
        .agg(merge(F.when(F.col("probe") == 1, F.col("upto")).otherwise(F.col("after"))).alias(out))
    )


def rolling_counts(points: DataFrame, events: DataFrame, keys: list[str], horizon: int, out: str,
                   point_epoch: str = "epoch", event_epoch: str = "epoch") -> DataFrame:
    """Number of events in the last ``horizon`` seconds, see :func:`rolling`."""
    return rolling(points, events, keys, horizon, out, point_epoch, event_epoch, F.count("*"), F.sum,
                   lambda whole, upto: whole - upto)


def with_rolling_latest(df: DataFrame, events: DataFrame, keys: list[str], horizon: int, id_col: str, out: str,
                        point_epoch: str = "epoch", event_epoch: str = "epoch") -> DataFrame:
    """``df`` plus the highest id among the events of the last ``horizon`` seconds; null when there is none."""
    latest = rolling(df, events, keys, horizon, out, point_epoch, event_epoch, F.max(id_col), F.max)
    return df.join(latest, [*keys, point_epoch], "left")


def with_rolling_count(df: DataFrame, events: DataFrame, keys: list[str], horizon: int, out: str,
                       point_epoch: str = "epoch", event_epoch: str = "epoch") -> DataFrame:
    """``df`` plus the trailing count of :func:`rolling_counts` (0 when a key is null)."""
    counts = rolling_counts(df, events, keys, horizon, out, point_epoch, event_epoch)
    return (
        df.join(counts, [*keys, point_epoch], "left")
        .withColumn(out, F.coalesce(F.col(out), F.lit(0).cast("long")))
    )


def ranked_by_id(df: DataFrame, keys: list[str], id_col: str, out: str, block: int = 65_536) -> DataFrame:
    """1-based rank of ``id_col`` (unique, integer, any density) within ``keys``.

    Ids are cut into blocks of ``block``; a row's rank is its rank inside the block plus the rows of earlier blocks. The
    first window sorts at most ``block`` rows, the second one row per block.
    """
    numbered = df.withColumn("_block", F.floor(F.col(id_col) / block))
    per_block = numbered.groupBy(*keys, "_block").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    inside = Window.partitionBy(*keys, "_block").orderBy(id_col)
    return (
        numbered.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*keys, "_block"])
        .withColumn(out, (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_block", "_inside", "_before")
    )


def upper_median(df: DataFrame, value: str, keys: list[str], out: str, resolution: float = 1.0) -> DataFrame:
    """The element at index ``n // 2`` of each key's sorted values, exactly.

    Values are counted per coarse cell first; only the cell that holds the middle is then looked at value by value.
    """
    cell = F.floor(F.col(value) / resolution)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, cell.alias("_cell"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    by_cell = counts.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = (
        by_cell.withColumn("_upto", F.sum("_n").over(upto))
        .withColumn("_target", F.floor(F.sum("_n").over(Window.partitionBy(*keys)) / 2))
        .where((F.col("_upto") > F.col("_target")) & (F.col("_upto") - F.col("_n") <= F.col("_target")))
        .select(*keys, "_cell", (F.col("_target") - (F.col("_upto") - F.col("_n"))).alias("_left"))
    )
    inside = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        counts.join(middle, [*keys, "_cell"])
        .withColumn("_upto", F.sum("_n").over(inside))
        .where(F.col("_upto") > F.col("_left"))
        .groupBy(*keys).agg(F.min("_v").alias(out))
    )


def trailing_rows(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The last ``n`` rows per key; the rank limit is applied before the shuffle as well as after it."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n).drop("_rn")
