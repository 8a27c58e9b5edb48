"""Seats: occupancy profiles, peaks, opening windows, free alternatives and the composed availability answer.

Bookings are never paired with requests. They are summed per venue and start time first, which bounds what one venue-day can
hold by the minutes of a day, and requests read that profile through one equi-join on (venue, date).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seatwise.functions import lexicon
from seatwise.functions.scalars import absolute_minute, bound_minutes, date_label, hhmm, local_absolute_second, local_date, minutes_of

DAY = 1440
NOWHERE = -10 * DAY  # a start that overlaps nothing
_PROFILE = "array<struct<m:int,people:bigint,n:bigint>>"


def active(reservations: DataFrame) -> DataFrame:
    return reservations.where(F.col("status").isin(*lexicon.ACTIVE_STATUSES))


def booking_starts(reservations: DataFrame) -> DataFrame:
    """Guests and bookings per venue, date and start minute."""
    return active(reservations).groupBy("venue_id", "reservation_date", "reservation_min").agg(
        F.sum("people").alias("people"), F.count("*").alias("n"))


def on_days(reservations: DataFrame, days: DataFrame) -> DataFrame:
    """The bookings of the asked (venue_id, day) and of the day before each.

    Of a table laid out by date (``sources.booking_files``) only the folders of those dates are read: the join prunes them at run time.
    Spark does so for a side that has a predicate, hence the comparison, which every date meets.
    """
    wanted = days.select("venue_id", F.explode(F.array(F.col("day"), F.date_sub("day", 1))).alias("reservation_date")).where(
        F.col("reservation_date") >= F.lit("0001-01-01").cast("date")).distinct()
    return reservations.join(wanted, ["venue_id", "reservation_date"], "left_semi")


def day_profiles(reservations: DataFrame, days: DataFrame) -> DataFrame:
    """Per venue and asked day: starts of that day and the day before, in minutes relative to the asked day.

    Only those two days count, so a start after the following midnight is out by definition.
    """
    starts = booking_starts(on_days(reservations, days)).select(
        "venue_id", "people", "n",
        F.explode(F.array(
            F.struct(F.col("reservation_date").alias("day"), F.col("reservation_min").alias("m")),
            F.struct(F.date_add("reservation_date", 1).alias("day"), (F.col("reservation_min") - DAY).alias("m")),
        )).alias("at"))
    return starts.groupBy("venue_id", F.col("at.day").alias("day")).agg(
        F.collect_list(F.struct(F.col("at.m").alias("m"), "people", "n")).cast(_PROFILE).alias("profile"))


def near_starts(profile: Column, start: Column, slot: Column) -> Column:
    """Bookings whose slot overlaps [start, start + slot)."""
    known = F.coalesce(profile, F.array().cast(_PROFILE))
    return F.filter(known, lambda b: (b["m"] > start - slot) & (b["m"] < start + slot))


def peak_seated(near: Column, start: Column, slot: Column, own_start: Column | None = None,
                own_people: Column | None = None) -> Column:
    """Most guests seated at once in [start, start + slot).

    Occupancy only rises where a booking starts, so it is enough to look at ``start`` and at the starts inside the slot. A
    booking being moved is taken out of the count by its own start and party.
    """
    points = F.array_union(F.array(start), F.transform(F.filter(near, lambda b: b["m"] > start), lambda b: b["m"]))

    def seated(pt):
        total = F.aggregate(near, F.lit(0).cast("long"), lambda acc, b: acc + F.when(
            (b["m"] <= pt) & (pt < b["m"] + slot), b["people"]).otherwise(F.lit(0).cast("long")))
        if own_start is not None:
            mine = (own_start <= pt) & (pt < own_start + slot) & (own_start < DAY)
            total = total - F.when(mine, own_people).otherwise(0)
        return total

    return F.array_max(F.transform(points, seated)).cast("long")


SLOT = ["venue_id", "req_date", "req_min"]


def with_slots(requests: DataFrame, per_slot: DataFrame) -> DataFrame:
    """Every request with what is known of its (venue_id, req_date, req_min); keys that are null meet nulls, so none is lost.

    ``known_venue`` says whether the venue has a configuration: ``per_slot`` has a row (and a capacity) for just those slots.
    """
    renamed = per_slot.withColumnsRenamed({c: f"_{c}" for c in SLOT}).withColumn("known_venue", F.lit(True))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SLOT]
    return requests.join(renamed, same, "left").drop(*[f"_{c}" for c in SLOT]).withColumn(
        "known_venue", F.coalesce("known_venue", F.lit(False)))


def unanswerable() -> Column:
    """unknown_venue, or invalid_request where the date, the time or the party is missing; to be continued with further cases."""
    missing = F.col("req_date").isNull() | F.col("req_min").isNull() | F.col("people").isNull()
    return F.when(~F.col("known_venue"), "unknown_venue").when(missing, "invalid_request")


def near_of_slot() -> Column:
    """The starts near an asked slot (``profile``, ``slot_min``, req_date, req_min); null without date or time."""
    asked = F.col("req_date").isNotNull() & F.col("req_min").isNotNull()
    return F.when(asked, near_starts(F.col("profile"), F.col("req_min"), F.col("slot_min")))


def slot_peaks(slots: DataFrame, reservations: DataFrame, cfg: DataFrame) -> DataFrame:
    """Peak and seats left for each distinct (venue_id, req_date, req_min) of ``slots`` whose venue is known; null without date or time."""
    asked = slots.select(*SLOT).distinct()
    profiles = day_profiles(reservations, asked.select("venue_id", F.col("req_date").alias("day"))).withColumnRenamed("day", "req_date")
    return (
        asked.join(cfg.select("venue_id", "capacity", "slot_min"), "venue_id")
        .join(profiles, ["venue_id", "req_date"], "left")
        .withColumn("near", near_of_slot())
        .select(*SLOT, "capacity", "near", peak_seated(F.col("near"), F.col("req_min"), F.col("slot_min")).alias("max_seated"))
        .withColumn("seats_left", F.col("capacity") - F.col("max_seated"))
    )


def max_seated(requests: DataFrame, reservations: DataFrame, cfg: DataFrame) -> DataFrame:
    """``requests`` plus the peak of simultaneous guests, seats left and whether the party fits.

    Every request comes back once: of an unknown venue, or without date or time, with nulls (and ``known_venue``).
    """
    peaks = slot_peaks(requests, reservations, cfg).drop("near", "capacity")
    return with_slots(requests, peaks).withColumn("is_available", F.col("seats_left") >= F.col("people"))


def overlap_load(requests: DataFrame, reservations: DataFrame, cfg: DataFrame) -> DataFrame:
    """Bookings and guests whose slot overlaps the asked one (whether or not they are seated together); null where nothing can be said."""
    near = slot_peaks(requests, reservations, cfg).select(*SLOT, "near")
    zero = F.lit(0).cast("long")
    return with_slots(requests, near).select(
        *requests.columns,
        F.aggregate("near", zero, lambda a, b: a + b["n"]).alias("overlapping_bookings"),
        F.aggregate("near", zero, lambda a, b: a + b["people"]).alias("overlapping_guests"))


def evaluation_points(requests: DataFrame, reservations: DataFrame, cfg: DataFrame) -> DataFrame:
    """Distinct instants at which a request's occupancy is looked at: its own start and the starts inside its slot; null where the
    venue, the date or the time is not known."""
    near = slot_peaks(requests, reservations, cfg).select(*SLOT, "near")
    points = F.array_union(F.array("req_min"),
                           F.transform(F.filter("near", lambda b: b["m"] > F.col("req_min")), lambda b: b["m"]))
    return with_slots(requests, near.withColumn("points", points).drop("near"))


# ---------------------------------------------------------------------------------------------- opening hours

_HOURS = "map<string,array<struct<open:string,close:string>>>"


def opening_intervals(days: DataFrame, hours: DataFrame) -> DataFrame:
    """One row per interval of each (venue_id, day): hours are a JSON document of weekday -> intervals."""
    weekday = F.lower(F.date_format("day", "EEEE"))
    per_venue = hours.select("venue_id", F.from_json("opening_hours", _HOURS).alias("week"))
    return (
        days.join(per_venue, "venue_id")
        .withColumn("span", F.explode(F.try_element_at("week", weekday)))
        .select(*days.columns, minutes_of(F.col("span.open")).alias("open_min"), bound_minutes(F.col("span.close")).alias("close_min"))
    )


def opening_window(days: DataFrame, hours: DataFrame) -> DataFrame:
    """``days`` plus the earliest interval of their weekday; null bounds on a closed day."""
    weekday = F.lower(F.date_format("day", "EEEE"))
    per_venue = hours.select("venue_id", F.from_json("opening_hours", _HOURS).alias("week"))
    spans = F.transform(F.try_element_at("week", weekday), lambda s: F.struct(
        minutes_of(s["open"]).alias("open_min"), bound_minutes(s["close"]).alias("close_min")))
    return (
        days.join(per_venue, "venue_id", "left")
        .withColumn("first", F.array_min(spans))
        .select(*days.columns, "first.open_min", "first.close_min")
    )


def team_only_days(special_dates: DataFrame) -> DataFrame:
    return special_dates.where(F.col("booking_policy") == "team_only").select(
        "venue_id", "day", F.lit(True).alias("team_only")).distinct()


def day_facts(days: DataFrame, reservations: DataFrame, hours: DataFrame, special_dates: DataFrame) -> DataFrame:
    """Everything a request needs to know about its (venue_id, day): opening window, team-only flag, occupancy profile; all null of a day
    that is null."""
    asked = days.select("venue_id", "day").distinct()
    # said here, what joins further on would add to one reading of the bookings and not to the other: so they are one
    known = F.col("venue_id").isNotNull() & F.col("day").isNotNull()
    profiles = day_profiles(reservations, asked.where(known)).where(known)
    return (
        opening_window(asked, hours)
        .join(team_only_days(special_dates), ["venue_id", "day"], "left")
        .join(profiles, ["venue_id", "day"], "left")
        .withColumn("team_only", F.coalesce("team_only", F.lit(False)))
    )


# ------------------------------------------------------------------------------------------------ alternatives

def facts_ahead(days: DataFrame, reservations: DataFrame, cfg: DataFrame, hours: DataFrame, special_dates: DataFrame) -> DataFrame:
    """:func:`day_facts` of the given (venue_id, day) and of the two days after each, with the configuration, for venues that have one."""
    wanted = days.select("venue_id", "day").distinct().select("venue_id", F.explode(F.array(
        F.col("day"), F.date_add("day", 1), F.date_add("day", 2))).alias("day"))
    return day_facts(wanted, reservations, hours, special_dates).join(
        cfg.select("venue_id", "capacity", "slot_min", "days_ahead", "tz"), "venue_id")


def free_grid(facts: DataFrame, as_of: int) -> DataFrame:
    """Per (venue_id, day) of :func:`facts_ahead`: the bookable half-hours with their seats left, and those of the two days after.

    Half-hours run from opening to 30 minutes before closing, are not in the past, lie inside the booking window, and are
    never on a team-only day. At most 48 entries per day.
    """
    now = local_absolute_second(as_of, F.col("tz"))
    open_day = (~F.col("team_only") & F.col("open_min").isNotNull() & (F.col("close_min") - 30 >= F.col("open_min"))
                & (F.col("day") <= F.date_add(local_date(as_of, F.col("tz")), F.col("days_ahead"))))
    times = F.filter(F.sequence("open_min", F.col("close_min") - 30, F.lit(30)),
                     lambda m: absolute_minute(F.col("day"), m) * 60 >= now)
    # the overlapping starts are laid out once per half-hour, so that the peak does not search the day again and again
    laid_out = facts.where(open_day).select("venue_id", "day", "capacity", "slot_min", F.transform(times, lambda m: F.struct(
        m.alias("m"), near_starts(F.col("profile"), m, F.col("slot_min")).alias("near"))).alias("times"))
    grid = laid_out.select("venue_id", "day", F.transform("times", lambda t: F.struct(
        t["m"].alias("m"), (F.col("capacity") - peak_seated(t["near"], t["m"], F.col("slot_min"))).alias("seats"))).alias("slots"))
    served = grid.select("venue_id", "slots", F.posexplode(F.array(
        F.col("day"), F.date_sub("day", 1), F.date_sub("day", 2))).alias("k", "day"))
    return served.groupBy("venue_id", "day").agg(*[
        F.max(F.when(F.col("k") == k, F.col("slots"))).alias(f"slots_{k}") for k in range(3)])


def _alternatives(day: Column, minute: Column, people: Column, nearest: int) -> Column:
    none = F.array().cast("array<struct<m:int,seats:bigint>>")

    def fitting(k, keep):
        return F.filter(F.coalesce(F.col(f"slots_{k}"), none), lambda s: (s["seats"] >= people) & keep(s["m"]))

    def shown(d, m):
        return F.struct(d.cast("string").alias("date"), hhmm(m).alias("time"), date_label(d).alias("date_label"))

    ranked = F.array_sort(F.transform(fitting(0, lambda m: m != minute),
                                      lambda s: F.struct(F.abs(s["m"] - minute).alias("distance"), s["m"].alias("m"))))
    same_day = F.array_sort(F.transform(F.slice(ranked, 1, nearest), lambda s: s["m"]))

    def later(k):
        return F.transform(fitting(k, lambda m: m == minute), lambda s: shown(F.date_add(day, k), s["m"]))

    return F.concat(F.transform(same_day, lambda m: shown(day, m)), later(1), later(2))


def with_alternatives(df: DataFrame, grid: DataFrame, day: str, minute: str, people: str, out: str = "alternatives",
                      nearest: int = 3, where: Column | None = None, same=Column.__eq__) -> DataFrame:
    """``df`` plus up to three nearest free times of the asked day and the same time on the two days after; null where ``where`` does
    not hold, and worked out only where it does.

    A row meets its (venue, day) in the grid, which has one small row for each, so ``df`` is gone through once. Where ``df`` was just
    joined on venue and day by the same comparison, it lies as it is needed and is not shuffled again.
    """
    free = grid.withColumnsRenamed({"venue_id": "_venue", "day": "_day"})
    met = df.join(free, same(F.col("venue_id"), F.col("_venue")) & same(F.col(day), F.col("_day")), "left")
    found = F.when(F.col(day).isNotNull(), _alternatives(F.col(day), F.col(minute), F.col(people), nearest))
    return met.withColumn(out, found if where is None else F.when(where, found)).drop("_venue", "_day", *[f"slots_{k}" for k in range(3)])


def alternatives(requests: DataFrame, reservations: DataFrame, cfg: DataFrame, hours: DataFrame, special_dates: DataFrame,
                 as_of: int, nearest: int = 3) -> DataFrame:
    days = requests.select("venue_id", F.col("req_date").alias("day")).distinct()
    grid = free_grid(facts_ahead(days, reservations, cfg, hours, special_dates), as_of)
    return with_alternatives(requests, grid, "req_date", "req_min", "people", nearest=nearest)


# --------------------------------------------------------------------------------------------- composed answer

def check_availability(guarded: DataFrame, reservations: DataFrame, cfg: DataFrame, hours: DataFrame,
                       special_dates: DataFrame, as_of: int) -> DataFrame:
    """Status and alternatives for requests that already carry a ``guard`` column (see ``guards.booking_guard``).

    Our composition; first match wins: unknown_venue, invalid_request (no date, time or party), past_date, too_far_ahead, outside_hours,
    team_only_event, the guard's own answer, no_availability, available.
    """
    days = guarded.select("venue_id", F.col("req_date").alias("day")).distinct()
    facts = facts_ahead(days, reservations, cfg, hours, special_dates)
    # requests meet the facts and the grid of their day in one shuffle; keys that are null meet nulls, so a known venue is known without a date
    per_day = facts.withColumnsRenamed({"venue_id": "_venue", "day": "_day"}).withColumn("known_venue", F.lit(True))
    met = (
        guarded.join(per_day, F.col("venue_id").eqNullSafe(F.col("_venue")) & F.col("req_date").eqNullSafe(F.col("_day")), "left")
        .withColumn("known_venue", F.coalesce("known_venue", F.lit(False)))
        .withColumn("near", near_of_slot())
        .withColumn("seats_left", F.col("capacity") - peak_seated(F.col("near"), F.col("req_min"), F.col("slot_min")))
        .withColumn("calendar_status", calendar_status(F.col("req_date"), F.col("req_min"), as_of))
        .select(*guarded.columns, "seats_left", "calendar_status", "known_venue")
    )
    status = (
        unanswerable().when(F.col("calendar_status").isNotNull(), F.col("calendar_status"))
        .when(F.col("guard") != "ok", F.col("guard"))
        .when(F.col("seats_left") < F.col("people"), "no_availability")
        .otherwise("available"))
    return with_alternatives(met.withColumn("status", status), free_grid(facts, as_of), "req_date", "req_min", "people",
                             where=F.col("status") == "no_availability", same=Column.eqNullSafe)


def calendar_status(day: Column, minute: Column, as_of: int | Column) -> Column:
    """First of past_date, too_far_ahead, outside_hours, team_only_event that applies; else null.

    Expects open_min, close_min, team_only, days_ahead and tz beside the request.
    """
    tz = F.col("tz")
    closed = (F.col("open_min").isNull() | F.col("close_min").isNull() | (minute < F.col("open_min")) | (minute > F.col("close_min") - 30))
    return (
        F.when(absolute_minute(day, minute) * 60 < local_absolute_second(as_of, tz), "past_date")
        .when(day > F.date_add(local_date(as_of, tz), F.col("days_ahead")), "too_far_ahead")
        .when(closed, "outside_hours")
        .when(F.col("team_only"), "team_only_event"))
