"""Changing, cancelling and confirming bookings: quotes, results, next snapshots and audit rows.

Parquet has no update in place, so a mutation returns its results; ``*_snapshot`` turns them into the next state of the
table, to be written to a new path, and ``*_log`` into the rows to append to the change log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seatwise.functions import lexicon
from seatwise.functions.scalars import date_label, day_number, hhmm, mask_contact, minutes_of, nullif_blank
from seatwise.operators import availability as av
from seatwise.operators.guards import change_counts, sent_mail, valid_email, with_booking
from seatwise.operators.special import special_by_date

TEAM_STATUSES = ["team_only_event", "party_too_large", "limit_reached", "too_far_ahead"]
_VALUES = ["date", "min", "people", "zone", "requests"]


def asked_values() -> dict:
    """The date, minute and party a command asks for (null: as it is), and whether one of them is given but cannot be read: an
    impossible date or time, or a party that is no whole number above 0."""
    day, minute, people = (nullif_blank(F.col(c)) for c in ("new_date", "new_time", "new_people"))
    w_date, w_minute, w_people = day.try_cast("date"), minutes_of(minute), people.try_cast("int")
    unreadable = ((day.isNotNull() & w_date.isNull()) | (minute.isNotNull() & w_minute.isNull())
                  | (people.isNotNull() & (w_people.isNull() | (w_people < 1))))
    return {"w_date": w_date, "w_minute": w_minute, "w_people": w_people, "unreadable": unreadable}


def proposed_change(authorized: DataFrame) -> DataFrame:
    """The booking as the command wants it (``n_*``): blanks and unknown zones keep the old value, notes are appended. What cannot be
    read keeps the old value too and sets ``unreadable``."""
    zone = F.lower(F.trim("new_zone"))
    extra = nullif_blank(F.col("new_request"))
    old_note = F.when(F.col("special_requests") != "", F.col("special_requests"))
    return (
        authorized.withColumns(asked_values())
        .withColumn("n_date", F.coalesce("w_date", "reservation_date"))
        .withColumn("n_min", F.coalesce("w_minute", "reservation_min"))
        .withColumn("n_people", F.when(F.col("w_people") >= 1, F.col("w_people")).otherwise(F.col("people")))
        .withColumn("n_zone", F.when(zone.isin("indoor", "terrace"), zone).otherwise(F.col("zone")))
        .withColumn("n_requests", F.when(extra.isNull(), F.col("special_requests")).otherwise(F.concat_ws("; ", old_note, extra)))
        .drop("w_date", "w_minute", "w_people")
    )


def unchanged():
    pairs = (("n_date", "reservation_date"), ("n_min", "reservation_min"), ("n_people", "people"), ("n_zone", "zone"),
             ("n_requests", "special_requests"))
    out = F.lit(True)
    for new, old in pairs:
        out = out & F.col(new).eqNullSafe(F.col(old))
    return out


def asked_days(proposed: DataFrame) -> DataFrame:
    """The (venue_id, day) that changes ask for. Who owns the booking does not matter here, so Spark leaves that join out, and the same
    text for the quote and for its alternatives lets it read the bookings once."""
    return proposed.where(F.col("venue_id").isNotNull() & F.col("n_date").isNotNull()).select(
        "venue_id", F.col("n_date").alias("day")).distinct()


def quote_modification(commands: DataFrame, reservations: DataFrame, customers: DataFrame, cfg: DataFrame, hours: DataFrame,
                       special_dates: DataFrame, log: DataFrame, as_of: int) -> DataFrame:
    """One row per command with ``status``: what the change would do to the given snapshot, first match wins."""
    booked = with_booking(commands, reservations, customers, cfg, as_of)
    found = F.col("authorized") & F.col("status").isin(*lexicon.ACTIVE_STATUSES)
    proposed = proposed_change(booked.withColumn("found", found).withColumnRenamed("status", "old_status"))
    limits = cfg.select("venue_id", "capacity", "slot_min", "days_ahead", "max_party", "max_changes_day", "tz", "team_contact")
    # only a booking near the asked time has to be taken out of the count
    own = ((day_number(F.col("reservation_date")) - day_number(F.col("n_date"))) * av.DAY + F.col("reservation_min")).cast("int")
    near_own = F.col("found") & (F.abs(own - F.col("n_min")) < F.col("slot_min"))
    asked = proposed.join(limits, "venue_id", "left").withColumn("own_start", F.when(near_own, own).otherwise(av.NOWHERE)).withColumn(
        "own_people", F.when(near_own, F.col("people")).otherwise(0))
    facts = av.day_facts(asked_days(asked), reservations, hours, special_dates).withColumnRenamed("day", "n_date")
    joined = (
        asked.join(change_counts(log, as_of), "reservation_id", "left")
        .withColumn("changes_total", F.coalesce("changes_total", F.lit(0)))
        .withColumn("changes_last_day", F.coalesce("changes_last_day", F.lit(0)))
        .join(facts, ["venue_id", "n_date"], "left")  # last, so that what is joined on venue and day next finds the rows in place
        .withColumn("near", F.when(F.col("found"), av.near_starts(F.col("profile"), F.col("n_min"), F.col("slot_min"))))
        .withColumn("seats_left", F.col("capacity") - av.peak_seated(
            F.col("near"), F.col("n_min"), F.col("slot_min"), F.col("own_start"), F.col("own_people")))
        .drop("profile", "near", "capacity", "slot_min")
    )
    calendar = av.calendar_status(F.col("n_date"), F.col("n_min"), as_of)
    status = (
        F.when(~F.col("found"), "not_found")
        .when(F.col("unreadable"), "invalid_request")
        .when(unchanged(), "no_changes")
        .when(calendar.isNotNull(), calendar)
        .when(F.col("n_people") > F.col("max_party"), "party_too_large")
        .when(F.col("changes_last_day") >= F.col("max_changes_day"), "limit_reached")
        .when(F.col("seats_left") < F.col("n_people"), "no_availability")
        .otherwise("modified"))
    return joined.withColumn("status", status).drop("own_start", "own_people")


def modification_result(quoted: DataFrame, reservations: DataFrame, cfg: DataFrame, hours: DataFrame,
                        special_dates: DataFrame, as_of: int) -> DataFrame:
    """The answer to each command: values in force, old values, labels, change number, alternatives, special day, contact."""
    done = F.col("status") == "modified"
    shown = {"reservation_date": "n_date", "reservation_min": "n_min", "people": "n_people", "zone": "n_zone",
             "special_requests": "n_requests"}
    grid = av.free_grid(av.facts_ahead(asked_days(quoted), reservations, cfg, hours, special_dates), as_of)
    special = special_by_date(special_dates, cfg).withColumnRenamed("day", "n_date")
    current = {old: F.when(done, F.col(new)).otherwise(F.col(old)) for old, new in shown.items()}
    answered = (
        av.with_alternatives(quoted, grid, "n_date", "n_min", "n_people", where=F.col("status") == "no_availability")
        .join(special, ["venue_id", "n_date"], "left")
    )
    found = F.col("found")
    none = F.lit(None)
    return answered.select(
        "command_id", "status",
        F.when(done, F.col("reservation_id")).alias("reservation_id"),
        F.when(found, F.col("confirmation_code")).alias("confirmation_code"),
        F.when(found, current["reservation_date"].cast("string")).alias("reservation_date"),
        F.when(found, hhmm(current["reservation_min"])).alias("reservation_time"),
        F.when(found, current["people"]).alias("people"),
        F.when(found, current["zone"]).alias("zone"),
        F.when(found, current["special_requests"]).alias("special_requests"),
        F.when(found, date_label(current["reservation_date"])).alias("date_label"),
        F.when(found, date_label(F.col("reservation_date"))).alias("old_date_label"),
        F.when(found, F.col("reservation_date").cast("string")).alias("old_reservation_date"),
        F.when(found, hhmm(F.col("reservation_min"))).alias("old_time"),
        F.when(found, F.col("people")).alias("old_people"),
        F.when(found, date_label(F.col("n_date"))).alias("requested_date_label"),
        F.when(found, F.col("guest_name")).alias("guest_name"),
        F.when(found, F.col("guest_lang")).alias("guest_lang"),
        F.when(found, F.col("email_to")).alias("email_to"),
        (F.col("changes_total") + 1).alias("change_seq"),
        "alternatives",
        F.when(found, F.coalesce("special", F.array().cast(special.schema["special"].dataType))).otherwise(none).alias("special"),
        F.when(F.col("status").isin(*TEAM_STATUSES), F.col("team_contact")).alias("team_contact"),
    )


def change_log_rows(changes: DataFrame, action: str, old: dict[str, str], new: dict, created_epoch: int) -> DataFrame:
    """Audit rows: JSON of the old and new values and the acting channel."""
    channel = F.coalesce(nullif_blank(F.col("cmd_channel")), F.lit("unknown"))

    def document(values):
        return F.to_json(F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in values.items()]),
                         {"ignoreNullFields": "false"})

    return changes.select(
        "reservation_id", F.lit(action).alias("action"), document(old).alias("old_values"), document(new).alias("new_values"),
        F.concat(F.lit("agent:"), channel).alias("actor"), F.lit(created_epoch).cast("long").alias("created_epoch"))


def modification_log(quoted: DataFrame, as_of: int) -> DataFrame:
    old = {"date": "reservation_date", "time": hhmm(F.col("reservation_min")), "people": "people", "zone": "zone",
           "special_requests": "special_requests"}
    new = {"date": "n_date", "time": hhmm(F.col("n_min")), "people": "n_people", "zone": "n_zone", "special_requests": "n_requests"}
    return change_log_rows(quoted.where(F.col("status") == "modified"), "modified", old, new, as_of)


# ---------------------------------------------------------------------------------------------------- cancelling

def apply_cancellations(commands: DataFrame, reservations: DataFrame, customers: DataFrame, cfg: DataFrame, as_of: int) -> DataFrame:
    """One row per command: not_authorized, cancelled (the first valid command on an active booking) or already_cancelled."""
    booked = with_booking(commands, reservations, customers, cfg, as_of).withColumnRenamed("status", "old_status")
    active = F.col("authorized") & F.col("old_status").isin(*lexicon.ACTIVE_STATUSES)
    winners = booked.where(active).groupBy("reservation_id").agg(F.min("command_id").alias("winner"))
    status = (
        F.when(~F.col("authorized"), "not_authorized")
        .when(F.col("winner") == F.col("command_id"), "cancelled")
        .otherwise("already_cancelled"))
    return booked.join(winners, "reservation_id", "left").withColumn("status", status).drop("winner")


def cancellation_result(applied: DataFrame) -> DataFrame:
    """What the caller and the cancellation message see; empty unless this command cancelled the booking."""
    won = F.col("status") == "cancelled"

    def only(c):
        return F.when(won, c)

    return applied.select(
        "command_id", "status", only(F.col("reservation_id")).alias("reservation_id"),
        only(F.col("confirmation_code")).alias("confirmation_code"),
        only(F.col("reservation_date").cast("string")).alias("reservation_date"),
        only(hhmm(F.col("reservation_min"))).alias("reservation_time"), only(F.col("people")).alias("people"),
        only(F.col("zone")).alias("zone"), only(date_label(F.col("reservation_date"))).alias("date_label"),
        only(F.col("email_to")).alias("email_to"), only(F.col("guest_name")).alias("guest_name"),
        only(F.col("guest_lang")).alias("guest_lang"))


def cancellation_log(applied: DataFrame, as_of: int) -> DataFrame:
    old = {"date": "reservation_date", "time": hhmm(F.col("reservation_min")), "people": "people", "zone": "zone",
           "status": "old_status"}
    return change_log_rows(applied.where(F.col("status") == "cancelled"), "cancelled", old, {"status": F.lit("cancelled")}, as_of)


def cancelled_snapshot(reservations: DataFrame, applied: DataFrame) -> DataFrame:
    gone = applied.where(F.col("status") == "cancelled").select("reservation_id", F.lit(True).alias("_gone"))
    return reservations.join(gone, "reservation_id", "left").withColumn(
        "status", F.when(F.col("_gone"), "cancelled").otherwise(F.col("status"))).drop("_gone")


# -------------------------------------------------------------------------------------------------- confirmation

def checked_confirmations(commands: DataFrame, reservations: DataFrame, customers: DataFrame, cfg: DataFrame,
                          as_of: int) -> DataFrame:
    """Commands with the checks that do not depend on their order: ``check`` is null for those still in the running.

    Counts of mail already sent are those at ``as_of``, the instant the whole batch is decided.
    """
    booked = with_booking(commands.withColumn("email", F.lower(F.trim("email"))), reservations, customers, cfg, as_of)
    found = F.col("authorized") & F.col("status").isin(*lexicon.ACTIVE_STATUSES)
    sent = sent_mail(reservations).where(F.col("sent_epoch") <= as_of)
    per_address = sent.where(F.col("sent_epoch") > as_of - 86_400).groupBy(
        "venue_id", F.col("address").alias("email")).agg(F.count("*").alias("sent_to_address"))
    per_venue = sent.where(F.col("sent_epoch") > as_of - 3600).groupBy("venue_id").agg(F.count("*").alias("sent_last_hour"))
    zero = F.lit(0).cast("long")
    check = (
        F.when(~found, "not_found")
        .when(~valid_email(F.col("email")), "invalid_email")
        .when(F.col("email_sent_epoch").isNotNull(), "already_sent"))
    return (
        booked.withColumn("check", check)
        .join(cfg.select("venue_id", "max_email_addr_day", "max_email_hour"), "venue_id", "left")
        .join(per_address, ["venue_id", "email"], "left")
        .join(per_venue, "venue_id", "left")
        .withColumn("address_quota", F.greatest(F.col("max_email_addr_day") - F.coalesce("sent_to_address", zero), zero))
        .withColumn("venue_quota", F.greatest(F.col("max_email_hour") - F.coalesce("sent_last_hour", zero), zero))
    )


def confirmation_result(decided: DataFrame) -> DataFrame:
    """One row per command: status, the claimed booking, what the message needs, and the masked earlier address."""
    found = F.col("status") != "not_found"
    return decided.select(
        "command_id", "status", F.when(F.col("status") == "ok", F.col("reservation_id")).alias("claimed_reservation_id"),
        F.when(found, F.col("confirmation_code")).alias("confirmation_code"),
        F.when(found, F.col("reservation_date").cast("string")).alias("reservation_date"),
        F.when(found, date_label(F.col("reservation_date"))).alias("date_label"),
        F.when(found, hhmm(F.col("reservation_min"))).alias("reservation_time"),
        F.when(found, F.col("people")).alias("people"), F.when(found, F.col("zone")).alias("zone"),
        F.when(found, F.col("special_requests")).alias("special_requests"),
        F.when(found, F.col("guest_name")).alias("guest_name"), "email", "language",
        F.when(found, mask_contact(F.col("email_to"))).alias("sent_to_masked"))


def confirmed_snapshot(reservations: DataFrame, decided: DataFrame, as_of: int) -> DataFrame:
    """Bookings after the batch: a claimed one carries its address and the time of sending."""
    claimed = decided.where(F.col("status") == "ok").select("reservation_id", F.col("email").alias("_email"))
    sent = F.col("_email").isNotNull()
    return reservations.join(claimed, "reservation_id", "left").withColumn(
        "email_sent_epoch", F.when(sent, F.lit(as_of).cast("long")).otherwise(F.col("email_sent_epoch"))).withColumn(
        "email_to", F.when(sent, F.col("_email")).otherwise(F.col("email_to"))).drop("_email")


def customers_with_address(customers: DataFrame, decided: DataFrame) -> DataFrame:
    """Customers after the batch: the address of the last claimed booking is stored on its customer too."""
    last = decided.where(F.col("status") == "ok").groupBy("customer_id").agg(F.max_by("email", "command_id").alias("_email"))
    return customers.join(last, "customer_id", "left").withColumn("email", F.coalesce("_email", "email")).drop("_email")


def release_claims(reservations: DataFrame, failures: DataFrame) -> DataFrame:
    """Sending failed: the booking may be claimed again; the address stays on the customer."""
    failed = failures.select("reservation_id", F.lit(True).alias("_failed")).distinct()
    cleared = F.coalesce("_failed", F.lit(False))
    return reservations.join(failed, "reservation_id", "left").withColumn(
        "email_sent_epoch", F.when(~cleared, F.col("email_sent_epoch"))).withColumn(
        "email_to", F.when(~cleared, F.col("email_to"))).drop("_failed")
