"""Known answers and boundaries of occupancy, alternatives, opening hours and guards."""

import pytest
from pyspark.sql import functions as F

from seatwise.operators import availability as av, changes, guards
from tests import tables as t


def evening(start, date, minute, n, people, status="confirmed"):
    return [t.reservation(start + i, date, minute, people, status) for i in range(n)]


OCTOBER = (
    evening(0, "2026-10-10", 1200, 20, 4) + evening(100, "2026-10-15", 1200, 20, 4, "cancelled") + evening(200, "2026-10-16", 1200, 20, 4, "pending")
    + evening(300, "2026-10-17", 1200, 19, 4) + evening(350, "2026-10-17", 1200, 1, 3)
    + evening(400, "2026-10-24", 1140, 10, 4) + evening(450, "2026-10-24", 1260, 10, 4)
    + evening(500, "2026-10-31", 1080, 20, 4) + evening(550, "2026-10-31", 1200, 20, 4) + evening(600, "2026-10-31", 1320, 20, 4))


@pytest.mark.parametrize("date,minute,peak", [
    ("2026-10-10", 1200, 80), ("2026-10-15", 1200, 0), ("2026-10-16", 1200, 80), ("2026-10-17", 1200, 79), ("2026-10-24", 1200, 40),
    ("2026-10-24", 1140, 40), ("2026-10-31", 1140, 80), ("2026-10-31", 1200, 80), ("2026-10-31", 1390, 80)])
def test_october_scenarios(spark, date, minute, peak):
    row = av.max_seated(t.requests(spark, [t.request(1, date, minute, 1)]), t.reservations(spark, OCTOBER), t.cfg(spark)).first()
    assert (row.max_seated, row.seats_left, row.is_available) == (peak, 80 - peak, peak < 80)


@pytest.mark.parametrize("booked,asked,peak", [
    (("2026-10-20", 1080), 1200, 0),   # ends exactly when the asked slot starts
    (("2026-10-20", 1081), 1200, 5),
    (("2026-10-20", 1320), 1200, 0),   # starts exactly when the asked slot ends
    (("2026-10-20", 1319), 1200, 5),
    (("2026-10-19", 1410), 30, 5),     # the evening before reaches past midnight
    (("2026-10-21", 10), 1410, 0),     # a booking of the following date is never counted
])
def test_half_open_slots_and_dates(spark, booked, asked, peak):
    rows = t.reservations(spark, [t.reservation(1, *booked, 5)])
    assert av.max_seated(t.requests(spark, [t.request(1, "2026-10-20", asked, 1)]), rows, t.cfg(spark)).first().max_seated == peak


def test_venues_do_not_mix_and_equal_requests_survive(spark):
    rows = t.reservations(spark, [t.reservation(1, "2026-10-20", 1200, 5, venue=2)])
    asks = t.requests(spark, [t.request(1, "2026-10-20", 1200, 1), t.request(2, "2026-10-20", 1200, 1), t.request(3, "2026-10-20", 1200, 1, venue=2)])
    got = {r.request_id: r.max_seated for r in av.max_seated(asks, rows, t.cfg(spark, (1, 2))).collect()}
    assert got == {1: 0, 2: 0, 3: 5}


def alternatives(spark, asks, rows, special=(), text=t.EVERY_DAY, **cfg):
    got = av.alternatives(t.requests(spark, asks), t.reservations(spark, rows), t.cfg(spark, **cfg), t.hours(spark, text=text), t.specials(spark, special), t.AS_OF)
    return [(a["date"], a["time"]) for a in got.first().alternatives]


def test_alternatives_nearest_first_then_same_time_later(spark):
    rows = evening(0, "2026-10-20", 1200, 20, 4)
    got = alternatives(spark, [t.request(1, "2026-10-20", 1200, 2)], rows)
    # 18:00 still ends before the full slot; 22:00 and 22:30 start after it
    assert got == [("2026-10-20", "18:00"), ("2026-10-20", "22:00"), ("2026-10-20", "22:30"), ("2026-10-21", "20:00"), ("2026-10-22", "20:00")]


def test_alternatives_skip_past_closed_and_team_only(spark):
    gala = [(1, t.day("2026-10-16"), "gala", "Gala", None, "team_only", True, None, None)]
    got = alternatives(spark, [t.request(1, "2026-10-15", 1080, 2)], [], gala)
    assert got == [("2026-10-15", "18:30"), ("2026-10-15", "19:00"), ("2026-10-15", "19:30"), ("2026-10-17", "18:00")]
    late = t.EVERY_DAY.replace('"thursday":[{"open":"18:00"', '"thursday":[{"open":"16:00"')
    got = alternatives(spark, [t.request(1, "2026-10-15", 960, 2)], [], text=late)
    assert got[:3] == [("2026-10-15", "17:00"), ("2026-10-15", "17:30"), ("2026-10-15", "18:00")]  # 17:00 is now and still offered
    assert alternatives(spark, [t.request(1, "2027-01-13", 1080, 2)], [])[-1] == ("2027-01-13", "19:30")  # last day of the window


def test_opening_window_uses_the_earliest_interval_only(spark):
    text = '{"monday":[{"open":"18:00","close":"23:00"},{"open":"12:00","close":"15:00"}],"tuesday":[]}'
    days = spark.createDataFrame([(1, t.day("2026-10-19")), (1, t.day("2026-10-20")), (1, t.day("2026-10-21"))], "venue_id long, day date")
    got = {r.day.isoformat(): (r.open_min, r.close_min) for r in av.opening_window(days, t.hours(spark, text=text)).collect()}
    assert got == {"2026-10-19": (720, 900), "2026-10-20": (None, None), "2026-10-21": (None, None)}
    assert av.opening_intervals(days, t.hours(spark, text=text)).count() == 2


@pytest.mark.parametrize("people,upcoming,last_hour,guard", [
    (12, 0, 0, "ok"), (13, 9, 9, "party_too_large"), (2, 3, 0, "limit_reached"), (2, 2, 0, "ok"), (2, 0, 10, "limit_reached"), (2, 0, 9, "ok")])
def test_booking_guard_limits(spark, people, upcoming, last_hour, guard):
    rows = [t.reservation(i, "2026-10-15", 1200, 2, customer=1) for i in range(upcoming)]
    rows += [t.reservation(50 + i, "2026-10-01", 1200, 2, customer=1) for i in range(5)]  # past ones do not count
    rows += [t.reservation(100 + i, "2026-10-20", 1200, 2, customer=2, created=t.AS_OF - 3599) for i in range(last_hour)]
    rows += [t.reservation(200 + i, "2026-10-20", 1200, 2, customer=2, created=t.AS_OF - 3600) for i in range(20)]  # exactly an hour ago
    rows += [t.reservation(300 + i, "2026-10-20", 1200, 2, customer=2, channel="telegram", created=t.AS_OF) for i in range(20)]
    guests = t.guests(spark, [(1, "web", "phone:+9991", "A", None, "en"), (2, "telegram", "x", "B", None, "en")])
    asks = t.requests(spark, [t.request(1, "2026-10-20", 1200, people, phone="00999 (0)1".replace("(0)", ""))])
    assert guards.booking_guard(asks, t.reservations(spark, rows), guests, t.cfg(spark)).first().guard == guard


def command(i, code="RSV-00001", date="", time="", people="", zone="", note="", channel="web", customer=1, phone="+999 1"):
    return (i, 1, code, phone, channel, customer, date, time, people, zone, note, t.AS_OF)


def quote(spark, cmd, rows, log=(), special=(), text=t.EVERY_DAY, **cfg):
    guests = t.guests(spark, [(1, "web", "phone:+9991", "Ann", "Lee", "en"), (2, "web", "phone:+9992", "B", None, "es")])
    return changes.quote_modification(
        spark.createDataFrame([cmd], t.CMD), t.reservations(spark, rows), guests, t.cfg(spark, **cfg), t.hours(spark, text=text), t.specials(spark, special),
        spark.createDataFrame(list(log), t.LOG), t.AS_OF).first()


MINE = t.reservation(1, "2026-10-20", 1200, 4, note="no nuts")


@pytest.mark.parametrize("cmd,status", [
    (command(1, code="RSV-99999", people="2"), "not_found"), (command(1, phone="+999 2", people="2"), "not_found"),
    (command(1, code=" rsv-00001 ", people="2"), "modified"), (command(1), "no_changes"), (command(1, zone="roof"), "no_changes"),
    (command(1, channel="telegram", people="2"), "modified"), (command(1, channel="telegram", customer=2, people="2"), "not_found"),
    (command(1, date="2026-10-15", time="16:59"), "past_date"), (command(1, date="2027-01-14"), "too_far_ahead"),
    (command(1, date="2027-01-13"), "modified"), (command(1, time="17:59"), "outside_hours"), (command(1, time="22:30"), "modified"),
    (command(1, time="22:31"), "outside_hours"), (command(1, people="12"), "modified"), (command(1, people="13"), "party_too_large"),
    (command(1, note="Window"), "modified")])
def test_modification_statuses(spark, cmd, status):
    assert quote(spark, cmd, [MINE]).status == status


def test_modification_keeps_own_seats_and_counts_changes(spark):
    others = evening(100, "2026-10-20", 1200, 19, 4)
    assert quote(spark, command(1, time="20:30"), [MINE, *others]).status == "modified"  # own four seats move with it
    assert quote(spark, command(1, time="20:30", people="5"), [MINE, *others]).status == "no_availability"
    log = [(1, "modified", t.AS_OF - 86_399)] * 5
    assert quote(spark, command(1, people="2"), [MINE], log).status == "limit_reached"
    old = [(1, "modified", t.AS_OF - 86_400)] * 5 + [(1, "created", t.AS_OF)] * 5
    assert quote(spark, command(1, people="2"), [MINE], old).status == "modified"
    gala = [(1, t.day("2026-10-22"), "gala", "Gala", None, "team_only", True, None, None)]
    assert quote(spark, command(1, date="2026-10-22"), [MINE], special=gala).status == "team_only_event"
    closed = t.EVERY_DAY.replace('"thursday":[{"open":"18:00","close":"23:00"}]', '"thursday":[]')
    assert quote(spark, command(1, date="2026-10-22"), [MINE], text=closed).status == "outside_hours"
    row = quote(spark, command(1, note=" Window "), [MINE])
    assert row.n_requests == "no nuts; Window"


def test_cancellations_first_valid_command_wins(spark):
    rows = [t.reservation(1, "2026-10-20", 1200, 2), t.reservation(2, "2026-10-15", 1200, 2, "cancelled"), t.reservation(3, "2026-10-14", 1200, 2)]
    cmds = [(1, "rsv-00001", "+999 2", "web", 1), (2, " rsv-00001", "00999-1", "web", 1), (3, "RSV-00001", "+9991", "web", 1),
            (4, "RSV-00002", "+9991", "web", 1), (5, "RSV-00003", "+9991", "web", 1)]
    guests = t.guests(spark, [(1, "web", "phone:+9991", "Ann", "Lee", "en")])
    applied = changes.apply_cancellations(spark.createDataFrame(cmds, "command_id long, code string, phone string, channel string, customer_id long"),
                                          t.reservations(spark, rows), guests, t.cfg(spark), t.AS_OF)
    got = {r.command_id: r.status for r in applied.collect()}
    assert got == {1: "not_authorized", 2: "cancelled", 3: "already_cancelled", 4: "already_cancelled", 5: "not_authorized"}
    after = {r.reservation_id: r.status for r in changes.cancelled_snapshot(t.reservations(spark, rows), applied).collect()}
    assert after == {1: "cancelled", 2: "cancelled", 3: "confirmed"}
    log = changes.cancellation_log(applied, t.AS_OF).collect()
    assert len(log) == 1 and log[0].actor == "agent:web" and '"status":"confirmed"' in log[0].old_values


def test_confirmation_claims_and_release(spark):
    rows = t.reservations(spark, [t.reservation(1, "2026-10-20", 1200, 2, sent=t.AS_OF, to="a@b@example.org")])
    released = changes.release_claims(rows, spark.createDataFrame([(1,)], "reservation_id long")).first()
    assert released.email_sent_epoch is None and released.email_to is None
    masked = rows.select(changes.mask_contact(F.col("email_to")).alias("m")).first().m
    assert masked == "a***@example.org"  # the last @ counts
