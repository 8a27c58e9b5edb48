"""Admitting bookings from a stream: every micro-batch is one instant, decided by the batch operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from seatwise.operators.decisions import admit_bookings


def admission_batches(tables: Callable[[], dict[str, DataFrame]], decisions_path: str, instant: Callable[[DataFrame], int]):
    """A ``foreachBatch`` function: judge the micro-batch against the present tables, write one folder per batch id.

    ``tables`` reads the current reservations, customers, cfg, hours and special_dates, including what earlier batches
    admitted (see :func:`admitted_rows`). Writing by batch id makes a repeated batch replace itself.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        t, now = tables(), instant(batch)
        decided = admit_bookings(batch, t["reservations"], t["customers"], t["cfg"], t["hours"], t["special_dates"], now)
        decided.withColumn("decided_epoch", F.lit(now).cast("long")).write.mode("overwrite").parquet(f"{decisions_path}/batch_id={batch_id}")
    return run


def admitted_rows(decisions: DataFrame) -> DataFrame:
    """Confirmed requests in the shape of the reservations table, to be read beside it by the next batch."""
    return decisions.where(F.col("status") == "confirmed").select(
        F.col("request_id").alias("reservation_id"), "venue_id", "customer_id", F.lit("web").alias("channel"),
        F.col("req_date").alias("reservation_date"), F.col("req_min").alias("reservation_min"), "people", "status",
        "confirmation_code", F.col("decided_epoch").alias("created_epoch"))
