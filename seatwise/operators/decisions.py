"""Decisions that depend on the order of the commands: admitting bookings, claiming confirmations, applying changes.

A batch is decided as of one instant, its commands taken in order. What cannot be accepted whatever the order is settled with
joins beforehand; only the rest is walked. Where acceptance can only get harder along the batch (admissions, confirmations),
the rows worth walking are cut to a number the limits of a venue imply, so no walk grows with the data.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from seatwise.functions import lexicon
from seatwise.functions.scalars import day_number, local_absolute_second, local_date, nullif_blank, phone_normalize
from seatwise.operators import availability as av
from seatwise.operators.changes import asked_values
from seatwise.operators.conflicts import day_components, day_links, seen_days
from seatwise.operators.guards import HOUR, change_counts, upcoming_counts, with_booking
from seatwise.session import spread


def _first_rows(df: DataFrame, keys: list[str], order: list[str], n: Column) -> DataFrame:
    """The first ``n`` rows per key, where ``n`` is the same for all rows of a key."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n).drop("_rn")


# --------------------------------------------------------------------------------------------------- confirmations

def _sends_in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """Which commands of one venue send: one per booking, within what the address and the venue have left."""
    sent, per_address, out = set(), Counter(), []
    for r in rows.sort_values("command_id").itertuples():
        if len(out) >= r.venue_quota:
            break
        if r.reservation_id in sent or per_address[r.email] >= r.address_quota:
            continue
        sent.add(r.reservation_id)
        per_address[r.email] += 1
        out.append((r.reservation_id, r.command_id))
    return pd.DataFrame(out, columns=["reservation_id", "winner"])


def claim_confirmations(checked: DataFrame, cfg: DataFrame) -> DataFrame:
    """``changes.checked_confirmations`` plus ``status``: not_found, invalid_email, already_sent, rate_limited or ok.

    Bound on what is walked, with H sends left per venue and hour and A per address and day: a later copy of (booking,
    address) is never sent if the first was not; a booking's row fails only where its address is used up, so H + 1 rows per
    booking suffice; an address's row fails only where its booking was sent, so A + H per address; and per venue the rows
    skipped before the H-th send are at most H (H + 1) + H (A + H).
    """
    per_address, per_hour = F.col("per_address"), F.col("per_hour")
    limits = cfg.select("venue_id", F.col("max_email_addr_day").alias("per_address"), F.col("max_email_hour").alias("per_hour"))
    running = checked.join(limits, "venue_id").where(F.col("check").isNull() & (F.col("address_quota") > 0) & (F.col("venue_quota") > 0))
    rows = running.groupBy("venue_id", "reservation_id", "email").agg(
        F.min("command_id").alias("command_id"), *[F.max(c).alias(c) for c in ("address_quota", "venue_quota", "per_address", "per_hour")])
    rows = _first_rows(rows, ["reservation_id"], ["command_id"], per_hour + 1)
    rows = _first_rows(rows, ["venue_id", "email"], ["command_id"], per_address + per_hour)
    rows = _first_rows(rows, ["venue_id"], ["command_id"], per_hour * (2 * per_hour + per_address + 2))
    kinds = dict(checked.dtypes)
    sends = rows.groupBy("venue_id").applyInPandas(
        _sends_in_order, f"reservation_id {kinds['reservation_id']}, winner {kinds['command_id']}")
    status = (
        F.when(F.col("check").isNotNull(), F.col("check"))
        .when(F.col("winner") == F.col("command_id"), "ok")
        .when(F.col("winner") < F.col("command_id"), "already_sent")
        .otherwise("rate_limited"))
    return checked.withColumnRenamed("status", "booking_status").join(sends, "reservation_id", "left").withColumn("status", status).drop("winner")


# ------------------------------------------------------------------------------------------------------ admissions

def _peak(near: list[tuple[int, int]], start: int, slot: int) -> int:
    points = {start, *(m for m, _ in near if start < m < start + slot)}
    return max(sum(p for m, p in near if m <= pt < m + slot) for pt in points)


def _admitted_in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """Which requests of one venue get a table, in order; the state is what this batch has admitted so far."""
    admitted, per_phone = [], Counter()
    for r in rows.sort_values(["request_epoch", "request_id"]).itertuples():
        if len(admitted) >= r.venue_quota:
            break
        if per_phone[r.identity] >= r.phone_quota:
            continue
        # minutes are relative to the asked day; bookings of the following day never count
        new = [((day - r.day_no) * av.DAY + minute, people) for day, minute, people, *_ in admitted if day <= r.day_no]
        near = [*zip(r.near_starts, r.near_people), *new]
        if r.capacity - _peak(near, r.req_min, r.slot_min) < r.people:
            continue
        per_phone[r.identity] += 1
        admitted.append((r.day_no, r.req_min, r.people, r.venue_id, r.request_epoch, r.request_id, r.identity))
    return pd.DataFrame([a[3:] for a in admitted], columns=["venue_id", "request_epoch", "request_id", "identity"])


def admit_bookings(requests: DataFrame, reservations: DataFrame, customers: DataFrame, cfg: DataFrame, hours: DataFrame,
                   special_dates: DataFrame, as_of: int, prefix: str = "RSV-") -> DataFrame:
    """One row per web request with ``status``, and a code where it is confirmed. Our composition; first match wins:
    unknown_venue, invalid_request (no date, time or party), past_date, too_far_ahead, outside_hours, team_only_event, party_too_large, limit_reached, no_availability, confirmed.

    Bound on what is walked, with M bookings left per venue and hour and P per phone: a phone's later copies of one wish
    (day, time, party) beyond P are never admitted; a wish that does not fit never fits later, and at most M phones are
    used up within the batch, so M (1 + P) rows per wish suffice. Wishes per venue are limited by its booking window.
    """
    zero = F.lit(0).cast("long")
    web_last_hour = reservations.where((F.col("channel") == "web") & (F.col("created_epoch") > as_of - HOUR) & (F.col("created_epoch") <= as_of)).groupBy(
        "venue_id").agg(F.count("*").alias("made_last_hour"))
    limits = cfg.select("venue_id", "capacity", "slot_min", "days_ahead", "max_party", "max_per_phone", "max_per_hour", "tz").join(
        web_last_hour, "venue_id", "left").withColumn("today", local_date(as_of, F.col("tz")))
    slots = requests.select("venue_id", "req_date", "req_min").distinct()
    facts = av.day_facts(slots.select("venue_id", F.col("req_date").alias("day")), reservations, hours, special_dates)
    per_slot = (
        slots.join(facts.withColumnRenamed("day", "req_date"), ["venue_id", "req_date"], "left").join(limits, "venue_id")
        .withColumn("near", av.near_of_slot())
        .withColumn("seats_left", F.col("capacity") - av.peak_seated(F.col("near"), F.col("req_min"), F.col("slot_min")))
        .withColumn("calendar_status", av.calendar_status(F.col("req_date"), F.col("req_min"), as_of))
        .withColumn("venue_quota", F.greatest(F.col("max_per_hour") - F.coalesce("made_last_hour", zero), zero))
        .drop("profile", "open_min", "close_min", "team_only", "days_ahead", "tz", "made_last_hour")
    )
    upcoming = reservations.join(limits.select("venue_id", "today"), "venue_id").where(F.col("reservation_date") >= F.col("today"))
    booked = upcoming_counts(upcoming, customers).select("venue_id", F.col("channel_user_id").alias("identity"), F.col("n").alias("upcoming"))
    judged = (
        requests.withColumn("identity", F.concat(F.lit("phone:"), phone_normalize(F.col("phone"))))
        .transform(av.with_slots, per_slot).join(booked, ["venue_id", "identity"], "left")
        .withColumn("phone_quota", F.greatest(F.col("max_per_phone") - F.coalesce("upcoming", zero), zero))
        .withColumn("settled", av.unanswerable().when(F.col("calendar_status").isNotNull(), F.col("calendar_status"))
                    .when(F.col("people") > F.col("max_party"), "party_too_large")
                    .when((F.col("phone_quota") == 0) | (F.col("venue_quota") == 0), "limit_reached"))
        .drop("upcoming", "max_party", "today", "calendar_status")
    )
    wish = ["venue_id", "req_date", "req_min", "people"]
    order = ["request_epoch", "request_id"]
    running = judged.where(F.col("settled").isNull() & (F.col("seats_left") >= F.col("people")))
    running = _first_rows(running, [*wish, "identity"], order, F.col("max_per_phone"))
    running = _first_rows(running, wish, order, F.col("max_per_hour") * (1 + F.col("max_per_phone")))
    walked = running.select(
        "venue_id", "request_id", "request_epoch", "identity", "req_min", "people", "capacity", "slot_min", "phone_quota", "venue_quota",
        day_number(F.col("req_date")).alias("day_no"), F.transform("near", lambda b: b["m"]).alias("near_starts"),
        F.transform("near", lambda b: b["people"]).alias("near_people"))
    kinds = dict(requests.dtypes)
    admitted = spread(walked, "venue_id").groupBy("venue_id").applyInPandas(
        _admitted_in_order, f"venue_id {kinds['venue_id']}, request_epoch long, request_id {kinds['request_id']}, identity string")
    # At most M rows per venue were admitted, so every request can be placed among them without a shuffle of its own.
    taken = admitted.groupBy("venue_id").agg(F.collect_list(F.struct("request_epoch", "request_id", "identity")).alias("taken"))
    me = F.struct("request_epoch", "request_id")
    before = F.filter(F.coalesce("taken", F.array().cast(taken.schema["taken"].dataType)),
                      lambda a: F.struct(a["request_epoch"].alias("request_epoch"), a["request_id"].alias("request_id")) < me)
    won = F.exists(F.coalesce("taken", F.array().cast(taken.schema["taken"].dataType)), lambda a: a["request_id"] == F.col("request_id"))
    used_up = (F.size("before") >= F.col("venue_quota")) | (
        F.size(F.filter("before", lambda a: a["identity"] == F.col("identity"))) >= F.col("phone_quota"))
    status = (
        F.when(F.col("settled").isNotNull(), F.col("settled")).when(F.col("won"), "confirmed")
        .when(used_up, "limit_reached").otherwise("no_availability"))
    code = F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(F.concat(F.lit("request:"), F.col("request_id").cast("string")), 256), 1, 10)))
    return (
        judged.join(taken, "venue_id", "left").withColumn("before", before).withColumn("won", won)
        .withColumn("status", status)
        .withColumn("confirmation_code", F.when(F.col("status") == "confirmed", code))
        .select(*requests.columns, "status", "confirmation_code")
    )


# --------------------------------------------------------------------------------------------------------- changes

_COMMAND = ("command_id reservation_id day_no minute people zone note asks_day asks_minute asks_people w_day_no w_minute w_people w_zone w_note "
            "is_open open_min close_min team_only changes_last_day capacity slot_min days_ahead max_party max_changes_day now_s today_no").split()


def _judge_change(c: dict, state: tuple, seats: dict, changes: Counter):
    """Status of one command against the present state, and the booking's values after it."""
    day, minute, people, zone, note, hours = state
    new_hours = hours if hours and not c["asks_day"] else (c["is_open"], c["open_min"], c["close_min"], c["team_only"])
    n_day = c["w_day_no"] if c["asks_day"] else day
    n_min = c["w_minute"] if c["asks_minute"] else minute
    n_people = c["w_people"] if c["asks_people"] else people
    n_zone = c["w_zone"] or zone
    n_note = note if c["w_note"] is None else "; ".join(x for x in (note, c["w_note"]) if x)
    new = (n_day, n_min, n_people, n_zone, n_note, new_hours)
    is_open, open_min, close_min, team_only = new_hours
    if new[:5] == (day, minute, people, zone, note):
        return "no_changes", new
    if (n_day * av.DAY + n_min) * 60 < c["now_s"]:
        return "past_date", new
    if n_day > c["today_no"] + c["days_ahead"]:
        return "too_far_ahead", new
    if not is_open or n_min < open_min or n_min > close_min - 30:
        return "outside_hours", new
    if team_only:
        return "team_only_event", new
    if n_people > c["max_party"]:
        return "party_too_large", new
    if c["changes_last_day"] + changes[c["reservation_id"]] >= c["max_changes_day"]:
        return "limit_reached", new
    slot = c["slot_min"]
    near = [((d - n_day) * av.DAY + m, p) for d in (n_day - 1, n_day) for m, p in seats.get(d, {}).items()]
    near = [(m, p) for m, p in near if n_min - slot < m < n_min + slot]
    own = (day - n_day) * av.DAY + minute
    if day <= n_day and n_min - slot < own < n_min + slot:
        near.append((own, -people))
    return ("no_availability" if c["capacity"] - _peak(near, n_min, slot) < n_people else "modified"), new


def _changes_in_order(batches):
    """Walk each component's rows in order: first its occupied starts, then its commands. The state is those starts and the
    bookings changed so far."""
    walked, seats, booked, changes = None, None, None, None
    columns = ["command_id", "reservation_id", "status", "n_day_no", "n_min", "n_people", "n_zone", "n_requests", "change_no"]
    for batch in batches:
        out = []
        for c in batch.to_dict("records"):
            if (c["venue_id"], c["component"]) != walked:
                walked, seats, booked, changes = (c["venue_id"], c["component"]), defaultdict(Counter), {}, Counter()
            if c["kind"] == 0:
                seats[c["day_no"]][c["minute"]] += c["people"]
                continue
            key = c["reservation_id"]
            state = booked.get(key) or (c["day_no"], c["minute"], c["people"], c["zone"], c["note"], None)
            status, new = _judge_change(c, state, seats, changes)
            if status == "modified":
                seats[state[0]][state[1]] -= state[2]
                seats[new[0]][new[1]] += new[2]
                booked[key] = new
                changes[key] += 1
                out.append((c["command_id"], key, status, *new[:5], changes[key]))
            else:
                out.append((c["command_id"], key, status, *[None] * 6))
        yield pd.DataFrame(out, columns=columns)


def apply_modifications(commands: DataFrame, reservations: DataFrame, customers: DataFrame, cfg: DataFrame, hours: DataFrame,
                        special_dates: DataFrame, log: DataFrame, as_of: int) -> DataFrame:
    """One row per command, in order of (command_epoch, command_id), each seeing what the earlier ones changed. ``n_*`` are the
    booking's values after a command that is ``modified``, else null.

    A change frees seats as well as taking them, so commands that can affect each other are walked in order. They can only do so
    if they name one booking, or bookings that may sit on one day of a venue: those are a component (see ``conflicts``), and each
    component is walked on its own. A component's commands stream through a task, sorted, never held as a group; of the bookings
    only the starts of its days are read. Settled beforehand, whatever the order: commands that name no bookable
    reservation, that ask for something unreadable, and those for a day on which no booking can be: a past one, or one beyond the
    booking window that is not the booking's own.
    """
    booked = with_booking(commands, reservations, customers, cfg, as_of)
    limits = cfg.select("venue_id", "capacity", "slot_min", "days_ahead", "max_party", "max_changes_day", "tz")
    zone = F.lower(F.trim("new_zone"))
    asked = booked.join(limits, "venue_id", "left").withColumns(asked_values()).withColumns({
        "day_no": day_number(F.col("reservation_date")), "w_day_no": day_number(F.col("w_date")),
        "now_s": local_absolute_second(as_of, F.col("tz")), "today_no": day_number(local_date(as_of, F.col("tz"))),
        "w_zone": F.when(zone.isin("indoor", "terrace"), zone)})
    found = F.col("authorized") & F.col("status").isin(*lexicon.ACTIVE_STATUSES)
    settled = (
        F.when(~F.coalesce(found, F.lit(False)), "not_found")
        .when(F.col("unreadable"), "invalid_request")
        .when(F.col("w_day_no") < F.col("today_no"), "past_date")
        .when((F.col("w_day_no") > F.col("today_no") + F.col("days_ahead")) & (F.col("w_day_no") != F.col("day_no")), "too_far_ahead"))
    asked = asked.withColumn("settled", settled)
    known = asked.where(F.col("settled").isNotNull()).select(
        "command_id", F.when(F.col("settled") != "not_found", F.col("reservation_id")).alias("reservation_id"), F.col("settled").alias("status"))

    wanted = asked.where(F.col("settled").isNull()).withColumns({
        "day": F.coalesce("w_date", "reservation_date"), "minute": F.col("reservation_min"), "people": F.col("people").cast("long")})
    components = day_components(day_links(wanted))
    day_info = av.opening_window(wanted.select("venue_id", "day").distinct(), hours).join(
        av.team_only_days(special_dates), ["venue_id", "day"], "left")
    zero = F.lit(0)
    walked = (
        wanted.join(components, ["venue_id", "day_no"])
        .join(day_info, ["venue_id", "day"]).join(change_counts(log, as_of), "reservation_id", "left")
        .withColumns({
            "kind": F.lit(1), "note": F.col("special_requests"), "w_note": nullif_blank(F.col("new_request")),
            "asks_day": F.col("w_day_no").isNotNull(), "asks_minute": F.col("w_minute").isNotNull(), "asks_people": F.col("w_people").isNotNull(),
            "w_day_no": F.coalesce("w_day_no", zero), "w_minute": F.coalesce("w_minute", zero), "w_people": F.coalesce("w_people", zero),
            "is_open": F.col("open_min").isNotNull() & F.col("close_min").isNotNull(), "open_min": F.coalesce("open_min", zero),
            "close_min": F.coalesce("close_min", zero), "team_only": F.coalesce("team_only", F.lit(False)),
            "changes_last_day": F.coalesce("changes_last_day", zero.cast("long"))})
        .select("venue_id", "component", "kind", "command_epoch", *_COMMAND))
    starts = (
        av.booking_starts(reservations).join(cfg.select("venue_id", "slot_min"), "venue_id")
        .withColumn("own_day", day_number(F.col("reservation_date")))
        .withColumn("day_no", F.explode(seen_days(F.col("own_day"), F.col("reservation_min"), F.col("slot_min"))))
        .join(components, ["venue_id", "day_no"])
        .select("venue_id", "component", F.lit(0).alias("kind"), zero.cast("long").alias("command_epoch"), F.col("own_day").alias("day_no"),
                F.col("reservation_min").alias("minute"), "people").distinct())
    plain = {c: F.lit(None if t == "string" else False if t == "boolean" else 0).cast(t) for c, t in walked.dtypes if c not in starts.columns}
    ordered = starts.withColumns(plain).select(*walked.columns).unionByName(walked).transform(spread, "venue_id", "component").sortWithinPartitions(
        "venue_id", "component", "kind", "command_epoch", "command_id")
    kinds = dict(walked.dtypes)
    decided = ordered.mapInPandas(
        _changes_in_order, f"command_id {kinds['command_id']}, reservation_id {kinds['reservation_id']}, status string, n_day_no int, n_min int, "
                           "n_people long, n_zone string, n_requests string, change_no long")
    n_date = F.date_add(F.lit("1970-01-01").cast("date"), F.col("n_day_no"))
    return decided.select("command_id", "reservation_id", "status", n_date.alias("n_date"), "n_min", F.col("n_people").cast("int").alias("n_people"),
                          "n_zone", "n_requests", "change_no").unionByName(known, allowMissingColumns=True)


def modified_snapshot(reservations: DataFrame, applied: DataFrame) -> DataFrame:
    """Bookings after the batch: each has the values of its last accepted command."""
    last = applied.where(F.col("status") == "modified").groupBy("reservation_id").agg(
        F.max_by(F.struct("n_date", "n_min", "n_people", "n_zone", "n_requests"), "change_no").alias("_new"))
    hit = F.col("_new").isNotNull()
    pairs = {"reservation_date": "n_date", "reservation_min": "n_min", "people": "n_people", "zone": "n_zone", "special_requests": "n_requests"}
    return reservations.join(last, "reservation_id", "left").withColumns(
        {old: F.when(hit, F.col(f"_new.{new}")).otherwise(F.col(old)) for old, new in pairs.items()}).drop("_new")
