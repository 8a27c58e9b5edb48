"""Calendar content: special days, the calendar reference text and legal notices."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seatwise.functions.scalars import date_label, local_date


def special_by_date(special_dates: DataFrame, cfg: DataFrame) -> DataFrame:
    """Per (venue_id, day): its entries ordered by kind; a team-only entry tells whom to write to."""
    contact = F.concat(F.lit("To reserve, write to the team at "), F.col("team_contact"), F.lit("."))
    note = F.when(F.col("booking_policy") == "team_only", F.concat_ws(" ", "guest_note", contact)).otherwise(F.col("guest_note"))
    entry = F.struct("kind", "title", "details", "booking_policy", "deposit_required", "price_note", note.alias("guest_note"))
    return special_dates.join(cfg.select("venue_id", "team_contact"), "venue_id").groupBy("venue_id", "day").agg(
        F.array_sort(F.collect_list(entry)).alias("special"))


def with_special(df: DataFrame, special_dates: DataFrame, cfg: DataFrame, day: str) -> DataFrame:
    """``df`` plus the special entries of its day; an empty array on an ordinary one."""
    found = special_by_date(special_dates, cfg).withColumnRenamed("day", day)
    return df.join(found, ["venue_id", day], "left").withColumn(
        "special", F.coalesce("special", F.array().cast(found.schema["special"].dataType)))


def insert_if_absent(target: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``target`` plus the rows of ``new`` whose key it does not have; of several new rows with one key the first by ``order``, then by value, is kept."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(order, *rest)).alias("_row")).select(*keys, "_row.*")
    absent = first.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(absent.select(*target.columns))


# ------------------------------------------------------------------------------------------ calendar reference

def _month_line(month):
    """``October 2026: Mon 5, 12, 19, 26 | Tue 6, …`` for the first day of a month."""
    def weekday_numbers(weekday):
        first = (1 + (weekday - F.weekday(month) + 7) % 7).cast("int")
        numbers = F.sequence(first, F.dayofmonth(F.last_day(month)), F.lit(7))
        return F.concat(F.date_format(F.date_add(month, first - 1), "EEE"), F.lit(" "),
                        F.array_join(F.transform(numbers, lambda n: n.cast("string")), ", "))

    weekdays = F.transform(F.sequence(F.lit(0), F.lit(6)), weekday_numbers)
    return F.concat(F.date_format(month, "MMMM yyyy"), F.lit(": "), F.array_join(weekdays, " | "))


def calendar_reference(cfg: DataFrame, special_dates: DataFrame, as_of: int) -> DataFrame:
    """Per venue: the day numbers of every weekday of each month in its booking window, and its special days, as text.

    Months are complete and follow from (today, window) alone, so they are an expression on the venue's row.
    """
    venues = cfg.select("venue_id", "tz", F.coalesce("days_ahead", F.lit(90)).alias("days_ahead")).withColumn(
        "today", local_date(as_of, F.col("tz"))).withColumn("last_day", F.date_add("today", F.col("days_ahead")))
    months = F.sequence(F.to_date(F.trunc("today", "month")), F.to_date(F.trunc("last_day", "month")), F.expr("INTERVAL 1 MONTH"))
    months_text = F.array_join(F.transform(months, _month_line), "\n")
    listed = special_dates.join(venues.select("venue_id", "today", "last_day"), "venue_id").where(
        F.col("day").between(F.col("today"), F.last_day("last_day")))
    tag = F.upper(F.replace("kind", F.lit("_"), F.lit(" ")))
    team = F.when(F.col("booking_policy") == "team_only", " (bookings through the team only)").otherwise("")
    entry = F.struct("day", "kind", F.concat(date_label(F.col("day")), F.lit(" ["), tag, F.lit("] "), "title", team).alias("text"))
    special = listed.groupBy("venue_id").agg(F.array_sort(F.collect_list(entry)).alias("entries")).select(
        "venue_id", F.array_join(F.transform("entries", lambda e: e["text"]), "; ").alias("special_text"))
    return (
        venues.join(special, "venue_id", "left")
        .select("venue_id", F.concat_ws(
            "\n",
            F.lit("# Calendar (weekday -> day numbers; read dates from here, never work them out yourself)"),
            F.concat(F.lit("Today is "), date_label(F.col("today")), F.lit(" ("), "tz", F.lit(").")),
            F.concat(F.lit("Table bookings open "), F.col("days_ahead").cast("string"),
                     F.lit(" days ahead: the last bookable date today is "), date_label(F.col("last_day")), F.lit(".")),
            months_text,
            F.concat(F.lit("Special dates (details come from the availability answer): "),
                     F.coalesce("special_text", F.lit("none")), F.lit(".")),
        ).alias("calendar_text"))
    )


# -------------------------------------------------------------------------------------------------------- notices

def notice_rollover(notices: DataFrame, notice_type: str, old_version: str, new_rows: DataFrame) -> DataFrame:
    """Deactivate one version of a notice and add the rows of the next as active ones."""
    retired = (F.col("notice_type") == notice_type) & (F.col("version") == old_version)
    kept = notices.withColumn("is_active", F.when(retired, False).otherwise(F.col("is_active")))
    return kept.unionByName(new_rows.withColumn("is_active", F.lit(True)).select(*notices.columns))


def active_notice_check(notices: DataFrame, notice_type: str, expected: int, version: str, keys: list[str]) -> DataFrame:
    """Per key: how many notices of a type are active, how many of another version, and whether that is as expected."""
    live = F.col("is_active") & (F.col("notice_type") == notice_type)
    counted = notices.groupBy(*keys).agg(
        F.count_if(live).alias("active_rows"), F.count_if(live & (F.col("version") != version)).alias("other_version"))
    return counted.withColumn("passed", (F.col("active_rows") == expected) & (F.col("other_version") == 0))


def assert_active_notices(notices: DataFrame, notice_type: str, expected: int, version: str) -> None:
    """Raise unless exactly ``expected`` notices of the type are active, all of ``version``."""
    row = active_notice_check(notices, notice_type, expected, version, []).first()
    if row is None or not row["passed"]:
        raise ValueError(f"unexpected active {notice_type} notices: {row}")


def current_notice(notices: DataFrame, keys: list[str], fallback_type: str = "legal_page", fallback: str = "en") -> DataFrame:
    """The newest active notice per key, type and language; one type falls back to another language where it has none."""
    live = notices.where("is_active")
    rest = [c for c in notices.columns if c not in (*keys, "notice_type", "language")]
    newest = live.groupBy(*keys, "notice_type", "language").agg(
        F.max_by(F.struct(*rest), F.struct("effective_epoch", "notice_id")).alias("_row"))
    wanted = notices.select(*keys, "notice_type", "language").distinct()
    default = newest.where((F.col("notice_type") == fallback_type) & (F.col("language") == fallback)).select(
        *keys, "notice_type", F.col("_row").alias("_default"))
    return (
        wanted.join(newest, [*keys, "notice_type", "language"], "left")
        .join(default, [*keys, "notice_type"], "left")
        .withColumn("fell_back", F.col("_row").isNull() & F.col("_default").isNotNull())
        .withColumn("_row", F.coalesce("_row", "_default"))
        .where(F.col("_row").isNotNull())
        .select(*keys, "notice_type", "language", "fell_back", "_row.*")
    )
