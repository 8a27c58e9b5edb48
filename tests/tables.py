"""Small literal tables in the shape the operators expect."""

import datetime as dt

from seatwise.schemas import (
    BOOKING_REQUESTS as REQ, CHANGE_COMMANDS as CMD, CHANGE_LOG as LOG, CUSTOMERS as GUEST, OPENING_HOURS as HOURS, RESERVATIONS as RES,
    SPECIAL_DATES as SPECIAL, VENUE_CONFIG as CFG,
)

AS_OF = 1792058400  # 2026-10-15 10:00 UTC, 17:00 in Bangkok
EVERY_DAY = "{" + ",".join(f'"{d}":[{{"open":"18:00","close":"23:00"}}]' for d in (
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")) + "}"


def day(text):
    return dt.date.fromisoformat(text)


def cfg(spark, venues=(1,), **over):
    base = dict(capacity=80, slot_min=120, days_ahead=90, max_party=12, max_per_phone=3, max_per_hour=10, max_email_addr_day=2,
                max_email_hour=20, max_changes_day=5, team_contact="team@example.org", tz="Asia/Bangkok") | over
    return spark.createDataFrame([(v, *base.values()) for v in venues], CFG)


def reservation(i, date, minute, people, status="confirmed", venue=1, customer=1, channel="web", zone="indoor", note=None, code=None,
                created=AS_OF - 100_000, sent=None, to=None):
    return (i, venue, customer, channel, day(date), minute, people, zone, status, note, code or f"RSV-{i:05d}", created, sent, to)


def reservations(spark, rows):
    return spark.createDataFrame(rows, RES)


def request(i, date, minute, people, venue=1, customer=1, phone="+999 1", epoch=AS_OF):
    return (i, venue, customer, phone, day(date), minute, people, epoch)


def requests(spark, rows):
    return spark.createDataFrame(rows, REQ)


def hours(spark, venues=(1,), text=EVERY_DAY):
    return spark.createDataFrame([(v, text) for v in venues], HOURS)


def specials(spark, rows=()):
    return spark.createDataFrame(list(rows), SPECIAL)


def guests(spark, rows):
    return spark.createDataFrame(rows, GUEST)
