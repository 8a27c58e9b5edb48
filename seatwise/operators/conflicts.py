"""Which ordered commands can affect each other: components of venue days that bookings may move between."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

DAY = 1440


def day_links(moves: DataFrame) -> DataFrame:
    """Distinct (venue_id, a, b): days one booking may occupy in turn, and the day after one where it may sit past midnight.

    ``moves`` has a row per command: venue_id, reservation_id, day_no and minute of the booking, w_day_no and w_minute wished for (null:
    as it is) and slot_min. Commands of one booking share its day, so their wishes are linked through it; a booking that may start
    so late that its slot passes midnight takes seats of the following day too.
    """
    per_booking = moves.groupBy("venue_id", "reservation_id", "day_no", "slot_min").agg(
        F.collect_set("w_day_no").alias("wished"), F.greatest(F.max("minute"), F.max("w_minute")).alias("latest"))
    held = per_booking.select("venue_id", "day_no", F.explode(F.array_union(F.array("day_no"), "wished")).alias("day"),
                              (F.col("latest") + F.col("slot_min") > DAY).alias("late"))
    own = F.array(F.struct(F.col("day_no").alias("a"), F.col("day").alias("b")))
    next_day = F.array(F.struct(F.col("day").alias("a"), (F.col("day") + 1).alias("b")))
    return held.select("venue_id", F.explode(F.when(F.col("late"), F.concat(own, next_day)).otherwise(own)).alias("l")).select(
        "venue_id", "l.a", "l.b").distinct()


def day_components(links: DataFrame) -> DataFrame:
    """(venue_id, day_no, component) of every linked day; the component is its least day.

    A venue's links are distinct pairs of calendar days, so one group holds the square of its days at most, however many bookings
    and commands there are.
    """
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        root = {}

        def find(day):
            while root.setdefault(day, day) != day:
                root[day] = day = root[root[day]]
            return day

        for a, b in zip(rows["a"], rows["b"], strict=True):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        return pd.DataFrame({"venue_id": rows["venue_id"].iloc[0], "day_no": list(root), "component": [find(day) for day in root]})

    kind = dict(links.dtypes)["venue_id"]
    return links.groupBy("venue_id").applyInPandas(solve, f"venue_id {kind}, day_no int, component int")


def seen_days(day: Column, minute: Column, slot: Column) -> Column:
    """The days whose seats a booking takes: its own, and the next where its slot passes midnight."""
    return F.when(minute + slot > DAY, F.array(day, day + 1)).otherwise(F.array(day))
