"""Generated bookings for load tests, spread over a calendar, reproducible without a random number generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seatwise.functions.scalars import day_number
from seatwise.operators.windows import ranked_by_id

WEEKDAY_STARTS, WEEKEND_STARTS = [1140, 1200, 1260], [1110, 1170, 1230, 1290]


def generate_bookings(venues: DataFrame, first: str, last: str, excluded: list[str], prefix: str = "RSV-T",
                      weekday_tables: int = 2, weekend_tables: int = 3, scenarios: DataFrame | None = None) -> DataFrame:
    """Bookings for each venue: every day of the range at fixed starts with a few tables each; Fridays and Saturdays have
    other starts, more tables and larger parties; excluded days stay empty but for the rows of ``scenarios``.

    Codes number a venue's bookings by (date, time, status, table); party sizes are a hash of venue, day, time and table.
    """
    def minutes(starts):
        return F.array(*[F.lit(m) for m in starts])

    weekend = F.weekday("reservation_date").isin(4, 5)
    days = venues.select("venue_id", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("reservation_date"))
    days = days.where(~F.col("reservation_date").isin(*[F.lit(d).cast("date") for d in excluded])) if excluded else days
    starts = days.select("*", weekend.alias("weekend"), F.explode(
        F.when(weekend, minutes(WEEKEND_STARTS)).otherwise(minutes(WEEKDAY_STARTS))).alias("reservation_min"))
    tables = starts.select("*", F.explode(F.when(F.col("weekend"), F.sequence(F.lit(1), F.lit(weekend_tables)))
                                          .otherwise(F.sequence(F.lit(1), F.lit(weekday_tables)))).alias("table_no"))
    spread = F.when(F.col("weekend"), 5).otherwise(3)
    seed = F.col("venue_id") * 17 + day_number(F.col("reservation_date")) * 7919 + F.col("reservation_min") * 31 + F.col("table_no") * 13
    rows = tables.select("venue_id", "reservation_date", "reservation_min", (2 + seed % spread).cast("int").alias("people"),
                         F.lit("confirmed").alias("status"), "table_no")
    if scenarios is not None:
        rows = rows.unionByName(scenarios)
    status_no = F.when(F.col("status") == "cancelled", 0).when(F.col("status") == "confirmed", 1).otherwise(2)
    # one number that orders a venue's bookings by date, time, status and table
    position = ((day_number(F.col("reservation_date")).cast("long") * 1440 + F.col("reservation_min")) * 3 + status_no) * 1000 + F.col("table_no")
    numbered = ranked_by_id(rows.withColumn("position", position), ["venue_id"], "position", "number", block=1440 * 3000)
    digits = F.col("number").cast("string")
    return numbered.withColumn("confirmation_code", F.concat(
        F.lit(prefix), F.col("venue_id").cast("string"), F.lit("-"), F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), "0"))).drop("position", "table_no", "number")
