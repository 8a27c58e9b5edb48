"""No request is lost: unknown venues and missing dates, times or parties get an answer of their own."""

import pytest

from seatwise.operators import availability as av, decisions, guards
from tests import tables as t


@pytest.fixture(scope="module")
def asks(spark):
    rows = [t.request(1, "2026-10-20", 1200, 2), t.request(2, "2026-10-20", 1200, 2, venue=9), t.request(3, "2026-10-20", 1200, 2, venue=None),
            t.request(4, "2026-10-20", None, 2), t.request(6, "2026-10-20", 1200, None)]
    rows.append((5, 1, 1, "+999 1", None, 1200, 2, t.AS_OF))
    return t.requests(spark, rows)


@pytest.fixture(scope="module")
def booked(spark):
    return t.reservations(spark, [t.reservation(1, "2026-10-20", 1200, 3, customer=1)])


def test_peaks_loads_and_points(spark, asks, booked):
    cfg = t.cfg(spark)
    peaks = {r.request_id: (r.max_seated, r.is_available, r.known_venue) for r in av.max_seated(asks, booked, cfg).collect()}
    assert peaks == {1: (3, True, True), 2: (None, None, False), 3: (None, None, False), 4: (None, None, True), 5: (None, None, True), 6: (3, None, True)}
    loads = {r.request_id: (r.overlapping_bookings, r.overlapping_guests) for r in av.overlap_load(asks, booked, cfg).collect()}
    assert loads == {1: (1, 3), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None), 6: (1, 3)}
    points = {r.request_id: r.points for r in av.evaluation_points(asks, booked, cfg).collect()}
    assert points == {1: [1200], 2: None, 3: None, 4: None, 5: None, 6: [1200]}


def test_guards_and_answers(spark, asks, booked):
    cfg, people = t.cfg(spark), t.guests(spark, [(1, "web", "phone:+9991", "Guest", None, "en")])
    guarded = guards.booking_guard(asks, booked, people, cfg)
    want = {1: "ok", 2: "unknown_venue", 3: "unknown_venue", 4: "ok", 5: "ok", 6: "ok"}
    assert {r.request_id: r.guard for r in guarded.collect()} == want
    answers = {r.request_id: r.status for r in av.check_availability(guarded, booked, cfg, t.hours(spark), t.specials(spark), t.AS_OF).collect()}
    invalid = dict.fromkeys((4, 5, 6), "invalid_request")
    assert answers == {1: "available", 2: "unknown_venue", 3: "unknown_venue"} | invalid
    admitted = decisions.admit_bookings(asks, booked, people, cfg, t.hours(spark), t.specials(spark), t.AS_OF)
    assert {r.request_id: r.status for r in admitted.collect()} == {1: "confirmed", 2: "unknown_venue", 3: "unknown_venue"} | invalid


def test_mail_of_unknown_venues(spark, booked):
    commands = spark.createDataFrame([(1, 1, "a@example.org", t.AS_OF), (2, 9, "a@example.org", t.AS_OF), (3, None, None, None)],
                                     "command_id long, venue_id long, email string, command_epoch long")
    assert {r.command_id: r.guard for r in guards.email_guard(commands, booked, t.cfg(spark)).collect()} == {
        1: "ok", 2: "unknown_venue", 3: "unknown_venue"}


def test_changes_that_cannot_be_read(spark):
    booked = t.reservations(spark, [t.reservation(i, "2026-10-20", 1200, 3, customer=1) for i in range(1, 8)])
    people = t.guests(spark, [(1, "web", "phone:+9991", "Guest", None, "en")])
    asked = [("2026-02-30", "", ""), ("", "25:10", ""), ("", "", "many"), ("", "", "0"), ("1969-12-31", "", ""), ("", "", "4"), ("2027-06-01", "", "")]
    commands = spark.createDataFrame([(i, 1, f"RSV-{i:05d}", "+999 1", "web", 1, *a, "", "", t.AS_OF) for i, a in enumerate(asked, 1)], t.CMD)
    log = spark.createDataFrame([], t.LOG)
    rows = decisions.apply_modifications(commands, booked, people, t.cfg(spark), t.hours(spark), t.specials(spark), log, t.AS_OF).collect()
    assert {r.command_id: r.status for r in rows} == dict.fromkeys((1, 2, 3, 4), "invalid_request") | {5: "past_date", 6: "modified", 7: "too_far_ahead"}


def test_changes_on_different_days_are_walked_apart(spark):
    """Commands that stay on their day make a component each; one that moves between two days joins them."""
    from seatwise.operators.conflicts import day_components, day_links
    kinds = "venue_id long, reservation_id long, day_no int, minute int, w_day_no int, w_minute int, slot_min int"
    moves = [(1, i, 100 + 2 * i, 1200, None, 1260, 120) for i in range(30)] + [(1, 50, 100, 1200, 104, None, 120), (1, 51, 100, 1200, 110, None, 120),
             (1, 52, 130, 1200, None, 1410, 120), (2, 53, 100, 1200, None, None, 120)]
    got = {(r.venue_id, r.day_no): r.component for r in day_components(day_links(spark.createDataFrame(moves, kinds))).collect()}
    assert got[1, 104] == got[1, 110] == got[1, 100] == 100 and got[1, 102] == 102 and got[2, 100] == 100
    assert got[1, 131] == got[1, 130] == 130 and len({v for k, v in got.items() if k[0] == 1}) == 28
