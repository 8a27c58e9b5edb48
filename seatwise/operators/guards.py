"""Who may act and how often: ownership, booking and e-mail limits, change counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seatwise.functions import lexicon
from seatwise.functions.scalars import local_date, phone_normalize
from seatwise.operators.availability import active
from seatwise.operators.windows import with_rolling_count

HOUR, DAY_SECONDS = 3600, 86_400


def with_booking(commands: DataFrame, reservations: DataFrame, customers: DataFrame, cfg: DataFrame, as_of: int) -> DataFrame:
    """Every command (command_id, code, phone, channel, customer_id, …) once, with the booking it names and ``authorized``.

    The code must match exactly after trimming and upper-casing, the booking must be for today (local) or later, and the
    caller must be its owner: on the web by the booking phone, on telegram by the customer id. Left joins keep one row
    per command whether or not a booking is found.
    """
    renamed = {"channel": "cmd_channel", "customer_id": "cmd_customer_id"}
    asked = commands.select(*[F.col(c).alias(renamed.get(c, c)) for c in commands.columns if c != "venue_id"]).withColumn(
        "confirmation_code", F.upper(F.trim("code")))
    owners = customers.select("customer_id", F.col("channel").alias("owner_channel"), "channel_user_id",
                              F.trim(F.concat_ws(" ", "name", "surname")).alias("guest_name"), F.col("language").alias("guest_lang"))
    upcoming = reservations.join(cfg.select("venue_id", "tz"), "venue_id").where(
        F.col("reservation_date") >= local_date(as_of, F.col("tz"))).drop("tz")
    by_phone = ((F.col("cmd_channel") == "web") & (F.col("owner_channel") == "web")
                & (F.col("channel_user_id") == F.concat(F.lit("phone:"), phone_normalize(F.col("phone")))))
    by_id = (F.col("cmd_channel") == "telegram") & (F.col("customer_id") == F.col("cmd_customer_id"))
    return (
        asked.join(upcoming, "confirmation_code", "left")
        .join(owners, "customer_id", "left")
        .withColumn("authorized", F.coalesce(by_phone | by_id, F.lit(False)))
    )


def authorize(commands: DataFrame, reservations: DataFrame, customers: DataFrame, cfg: DataFrame, as_of: int) -> DataFrame:
    """Only the commands whose caller owns the upcoming booking they name."""
    return with_booking(commands, reservations, customers, cfg, as_of).where("authorized")


def reservation_customer(reservations: DataFrame, customers: DataFrame) -> DataFrame:
    """Bookings with the guest they belong to."""
    people = customers.select("customer_id", F.col("channel_user_id"), F.trim(F.concat_ws(" ", "name", "surname")).alias("guest_name"),
                              F.col("language").alias("guest_lang"))
    return reservations.join(people, "customer_id")


def upcoming_counts(upcoming: DataFrame, customers: DataFrame) -> DataFrame:
    """Active ones of the given bookings per venue and web identity; summed per customer before customers are joined."""
    per_customer = active(upcoming).groupBy("venue_id", "customer_id").agg(F.count("*").alias("n"))
    web = customers.where(F.col("channel") == "web").select("customer_id", "channel_user_id")
    return per_customer.join(web, "customer_id").groupBy("venue_id", "channel_user_id").agg(F.sum("n").alias("n"))


def upcoming_per_identity(reservations: DataFrame, customers: DataFrame) -> DataFrame:
    """Active bookings per venue and web identity as a short list of (date, bookings)."""
    per_day = active(reservations).groupBy("venue_id", "customer_id", "reservation_date").agg(F.count("*").alias("n"))
    web = customers.where(F.col("channel") == "web").select("customer_id", "channel_user_id")
    return (
        per_day.join(web, "customer_id")
        .groupBy("venue_id", "channel_user_id", "reservation_date").agg(F.sum("n").alias("n"))
        .groupBy("venue_id", "channel_user_id")
        .agg(F.collect_list(F.struct("reservation_date", "n")).alias("booked"))
    )


def booking_guard(requests: DataFrame, reservations: DataFrame, customers: DataFrame, cfg: DataFrame) -> DataFrame:
    """``requests`` plus ``guard``: unknown_venue, party_too_large, limit_reached (phone, then venue hour) or ok.

    Each request is judged at its own ``request_epoch`` against the given bookings; every request comes back once.
    """
    limits = cfg.select("venue_id", "max_party", "max_per_phone", "max_per_hour", F.col("tz").alias("guard_tz"))
    known = upcoming_per_identity(reservations, customers)
    identity = F.concat(F.lit("phone:"), phone_normalize(F.col("phone")))
    web_bookings = reservations.where(F.col("channel") == "web")
    nothing = F.array().cast("array<struct<reservation_date:date,n:bigint>>")
    asked = (
        with_rolling_count(requests, web_bookings, ["venue_id"], HOUR, "bookings_last_hour", "request_epoch", "created_epoch")
        .join(limits, "venue_id", "left")
        .withColumn("channel_user_id", identity)
        .withColumn("today", local_date(F.col("request_epoch"), F.col("guard_tz")))
    )
    # a phone is counted once per day it asks on, not once per request
    per_phone = asked.select("venue_id", "channel_user_id", "today").distinct().join(known, ["venue_id", "channel_user_id"]).select(
        "venue_id", "channel_user_id", "today", F.aggregate(
            F.filter(F.coalesce("booked", nothing), lambda b: b["reservation_date"] >= F.col("today")),
            F.lit(0).cast("long"), lambda acc, b: acc + b["n"]).alias("bookings_of_phone"))
    counted = asked.join(per_phone, ["venue_id", "channel_user_id", "today"], "left").withColumn(
        "bookings_of_phone", F.coalesce("bookings_of_phone", F.lit(0).cast("long")))
    guard = (
        F.when(F.col("max_party").isNull(), "unknown_venue")
        .when(F.col("people") > F.col("max_party"), "party_too_large")
        .when(F.col("bookings_of_phone") >= F.col("max_per_phone"), "limit_reached")
        .when(F.col("bookings_last_hour") >= F.col("max_per_hour"), "limit_reached")
        .otherwise("ok"))
    return counted.withColumn("guard", guard).select(
        *requests.columns, "bookings_of_phone", "bookings_last_hour", "guard")


def sent_mail(reservations: DataFrame) -> DataFrame:
    """One row per confirmation already sent: venue, lower-cased address, instant."""
    return reservations.where(F.col("email_sent_epoch").isNotNull()).select(
        "venue_id", F.lower("email_to").alias("address"), F.col("email_sent_epoch").alias("sent_epoch"))


def email_guard(commands: DataFrame, reservations: DataFrame, cfg: DataFrame, epoch: str = "command_epoch") -> DataFrame:
    """``commands`` (venue_id, email, epoch) plus counts per address and day, per venue and hour, and ``guard``: unknown_venue,
    rate_limited or ok. Every command comes back once."""
    sent = sent_mail(reservations)
    asked = commands.withColumn("address", F.lower(F.trim("email")))
    counted = with_rolling_count(asked, sent, ["venue_id", "address"], DAY_SECONDS, "sent_to_address", epoch, "sent_epoch")
    counted = with_rolling_count(counted, sent, ["venue_id"], HOUR, "sent_last_hour", epoch, "sent_epoch")
    limits = cfg.select("venue_id", "max_email_addr_day", "max_email_hour")
    blocked = (F.col("sent_to_address") >= F.col("max_email_addr_day")) | (F.col("sent_last_hour") >= F.col("max_email_hour"))
    return counted.join(limits, "venue_id", "left").withColumn(
        "guard", F.when(F.col("max_email_hour").isNull(), "unknown_venue").when(blocked, "rate_limited").otherwise("ok")).drop("max_email_addr_day", "max_email_hour")


def change_counts(log: DataFrame, as_of: int) -> DataFrame:
    """Modifications per booking: all of them, and those of the last 24 hours."""
    return log.where(F.col("action") == "modified").groupBy("reservation_id").agg(
        F.count("*").alias("changes_total"),
        F.count_if(F.col("created_epoch") > as_of - DAY_SECONDS).alias("changes_last_day"))


def valid_email(email):
    return F.coalesce((F.length(email) <= lexicon.EMAIL_MAX_LENGTH) & email.rlike(lexicon.EMAIL_PATTERN), F.lit(False))
