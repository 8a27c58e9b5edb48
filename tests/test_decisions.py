"""Ordered decisions against a plain sequential model written from the definitions."""

import random

import pytest

from seatwise.operators import cases, changes, decisions
from tests import tables as t

TODAY_NO = 20741  # 2026-10-15
NOW_MIN = TODAY_NO * 1440 + 17 * 60


def day_no(d):
    return (d - t.day("1970-01-01")).days


def definition_peak(booked, d, m, slot=120):
    """``booked``: (day number, minute, people) of seated bookings."""
    s = d * 1440 + m
    near = [(bd * 1440 + bm, p) for bd, bm, p in booked if d - 1 <= bd <= d]
    points = {s} | {x for x, _ in near if s < x < s + slot}
    return max(sum(p for x, p in near if x <= pt < x + slot) for pt in points)


def random_bookings(rng, n, customers, **fixed):
    return [t.reservation(i, f"2026-10-{rng.randint(14, 22)}", rng.choice([1080, 1140, 1200, 1260, 1410]), rng.randint(1, 8),
                          status=rng.choice(["confirmed", "pending", "cancelled"]), customer=rng.randint(1, customers), **fixed) for i in range(1, n + 1)]


def guest_rows(n):
    return [(c, "web", f"phone:+999{c}", f"Guest {c}", None, "en") for c in range(1, n + 1)]


@pytest.mark.parametrize("seed,per_hour,per_phone,capacity", [(1, 8, 3, 30), (2, 40, 2, 40), (3, 3, 1, 20), (4, 60, 50, 25)])
def test_admit_bookings_in_order(spark, seed, per_hour, per_phone, capacity):
    rng = random.Random(seed)
    booked = random_bookings(rng, 60, 12)
    asks = [t.request(i, f"2026-10-{rng.randint(13, 21)}", rng.choice([1020, 1080, 1140, 1170, 1200, 1230, 1350]), rng.randint(1, 9),
                      customer=c, phone=f"+999 {c}", epoch=t.AS_OF - rng.randint(0, 50)) for i in range(1, 160) for c in [rng.randint(1, 12)]]
    closed = [(1, t.day("2026-10-18"), "gala", "Gala", None, "team_only", True, None, None)]
    got = {r.request_id: r.status for r in decisions.admit_bookings(
        t.requests(spark, asks), t.reservations(spark, booked), t.guests(spark, guest_rows(12)),
        t.cfg(spark, capacity=capacity, max_per_hour=per_hour, max_per_phone=per_phone, max_party=8), t.hours(spark), t.specials(spark, closed), t.AS_OF).collect()}

    seated = [(day_no(b[4]), b[5], b[6]) for b in booked if b[8] != "cancelled"]
    phones = {}
    for b in booked:
        if b[8] != "cancelled" and day_no(b[4]) >= TODAY_NO:
            phones[b[2]] = phones.get(b[2], 0) + 1
    made, want = 0, {}
    for i, _, c, _, d, m, p, _ in sorted(asks, key=lambda a: (a[7], a[0])):
        d = day_no(d)
        if d * 1440 + m < NOW_MIN:
            status = "past_date"
        elif d > TODAY_NO + 90:
            status = "too_far_ahead"
        elif m < 1080 or m > 1350:
            status = "outside_hours"
        elif d == day_no(t.day("2026-10-18")):
            status = "team_only_event"
        elif p > 8:
            status = "party_too_large"
        elif phones.get(c, 0) >= per_phone or made >= per_hour:
            status = "limit_reached"
        elif capacity - definition_peak(seated, d, m) < p:
            status = "no_availability"
        else:
            status = "confirmed"
            seated.append((d, m, p))
            phones[c] = phones.get(c, 0) + 1
            made += 1
        want[i] = status
    assert got == want
    assert len(set(want.values())) >= 5


@pytest.mark.parametrize("seed,per_address,per_hour", [(1, 2, 6), (2, 1, 20), (3, 3, 3), (4, 2, 50)])
def test_claim_confirmations_in_order(spark, seed, per_address, per_hour):
    """Several addresses per booking and several bookings per address."""
    rng = random.Random(seed)
    booked = [t.reservation(i, "2026-10-20", 1200, 2, status=rng.choice(["confirmed", "pending", "cancelled"]), customer=i,
                            sent=rng.choice([None, None, t.AS_OF - rng.choice([100, 5000, 90_000])])) for i in range(1, 25)]
    booked = [b[:13] + (f"a{rng.randint(1, 4)}@example.org" if b[12] else None,) for b in booked]
    commands = [(i, 1, f" rsv-{r:05d}", f"+999 {r}", "web", r, rng.choice([f" A{rng.randint(1, 6)}@Example.org", "nonsense"]), "en")
                for i in range(1, 120) for r in [rng.randint(1, 26)]]
    kinds = "command_id long, venue_id long, code string, phone string, channel string, customer_id long, email string, language string"
    cfg = t.cfg(spark, max_email_addr_day=per_address, max_email_hour=per_hour)
    checked = changes.checked_confirmations(spark.createDataFrame(commands, kinds), t.reservations(spark, booked), t.guests(spark, guest_rows(25)), cfg, t.AS_OF)
    got = {r.command_id: r.status for r in decisions.claim_confirmations(checked, cfg).collect()}

    by_id = {b[0]: b for b in booked}
    sends = [(b[13], b[12]) for b in booked if b[12]]
    sent, want = {b[0] for b in booked if b[12]}, {}
    for i, _, _, _, _, r, email, _ in commands:
        email = email.strip().lower()
        if r not in by_id or by_id[r][8] == "cancelled":
            status = "not_found"
        elif "@" not in email:
            status = "invalid_email"
        elif r in sent:
            status = "already_sent"
        elif sum(a == email and e > t.AS_OF - 86_400 for a, e in sends) >= per_address or sum(e > t.AS_OF - 3600 for _, e in sends) >= per_hour:
            status = "rate_limited"
        else:
            status = "ok"
            sent.add(r)
            sends.append((email, t.AS_OF))
        want[i] = status
    assert got == want
    assert len(set(want.values())) >= 4


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_apply_modifications_in_order(spark, seed):
    rng = random.Random(seed)
    booked = random_bookings(rng, 50, 8)
    owner = {b[0]: b[2] for b in booked}
    commands = [(i, 1, f"RSV-{r:05d}", f"+999 {owner.get(r, 1)}", "web", owner.get(r, 1), rng.choice(["", "", f"2026-10-{rng.randint(14, 22)}", "2027-03-01"]),
                 rng.choice(["", "18:00", "19:30", "21:00", "23:30"]), rng.choice(["", "", str(rng.randint(1, 13))]), rng.choice(["", "Terrace", "roof"]),
                 rng.choice(["", "", "near the sea"]), t.AS_OF + rng.randint(0, 9)) for i in range(1, 200) for r in [rng.randint(1, 51)]]
    log = [(rng.randint(1, 50), "modified", t.AS_OF - rng.choice([10, 100_000])) for _ in range(60)]
    closed = [(1, t.day("2026-10-19"), "gala", "Gala", None, "team_only", True, None, None)]
    applied = decisions.apply_modifications(
        spark.createDataFrame(commands, t.CMD), t.reservations(spark, booked), t.guests(spark, guest_rows(8)), t.cfg(spark, capacity=16),
        t.hours(spark), t.specials(spark, closed), spark.createDataFrame(log, t.LOG), t.AS_OF)
    rows = applied.collect()
    got = {r.command_id: r.status for r in rows}

    state = {b[0]: [day_no(b[4]), b[5], b[6], b[7], b[9]] for b in booked if b[8] != "cancelled"}
    findable = {k for k, v in state.items() if v[0] >= TODAY_NO}
    count = {k: sum(r == k and e > t.AS_OF - 86_400 for r, _, e in log) for k in owner}
    want = {}
    for c in sorted(commands, key=lambda c: (c[11], c[0])):
        i, r = c[0], int(c[2][4:])
        if r not in findable:
            want[i] = "not_found"
            continue
        old = state[r]
        new = list(old)
        if c[6]:
            new[0] = day_no(t.day(c[6]))
        if c[7]:
            new[1] = int(c[7][:2]) * 60 + int(c[7][3:])
        if c[8]:
            new[2] = int(c[8])
        if c[9] == "Terrace":
            new[3] = "terrace"
        if c[10]:
            new[4] = "; ".join(x for x in (old[4], c[10]) if x)
        others = [(v[0], v[1], v[2]) for k, v in state.items() if k != r]
        if new == old:
            status = "no_changes"
        elif new[0] * 1440 + new[1] < NOW_MIN:
            status = "past_date"
        elif new[0] > TODAY_NO + 90:
            status = "too_far_ahead"
        elif not 1080 <= new[1] <= 1350:
            status = "outside_hours"
        elif new[0] == day_no(t.day("2026-10-19")):
            status = "team_only_event"
        elif new[2] > 12:
            status = "party_too_large"
        elif count[r] >= 5:
            status = "limit_reached"
        elif 16 - definition_peak(others, new[0], new[1]) < new[2]:
            status = "no_availability"
        else:
            status = "modified"
            state[r] = new
            count[r] += 1
        want[i] = status
    assert got == want
    assert {"modified", "no_changes", "no_availability", "not_found"} <= set(want.values()) and len(set(want.values())) >= 6
    after = {r.reservation_id: (day_no(r.reservation_date), r.reservation_min, r.people, r.zone, r.special_requests)
             for r in decisions.modified_snapshot(t.reservations(spark, booked), applied).collect()}
    assert {k: after[k] for k in state} == {k: tuple(v) for k, v in state.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_open_cases_in_order(spark, seed):
    rng = random.Random(seed)
    asks = [(i, rng.choice([1, 2, 3, None]), rng.choice(["complaint", "wants_human", "tool_failure", "severe_allergy"]),
             rng.choice(["c", "c", "c", None]), 1_000_000 + rng.randint(0, 9000) // 7 * 7) for i in range(1000, 1400)]
    known = [(i, rng.choice([1, 2]), rng.choice(["complaint", "wants_human"]), 1_000_000 - rng.randint(0, 4000),
              rng.choice(["open", "claimed", "cancelled", "resolved"])) for i in range(1, 12)]
    got = {r.case_id: r.result for r in cases.open_cases(
        spark.createDataFrame(asks, "case_id long, session_key long, reason string, guest_contact string, epoch long"),
        spark.createDataFrame(known, "case_id long, session_key long, reason string, created_epoch long, status string")).collect()}
    rows, want = [(s, r, e, status) for _, s, r, e, status in known], {}
    for i, session, reason, contact, now in sorted(asks, key=lambda a: (a[4], a[0])):
        mine = [x for x in rows if session is not None and x[0] == session]
        if any(x[1] == reason and x[3] in ("open", "claimed") and x[2] > now - 900 for x in mine):
            result = "existing"
        elif contact is None:
            result = "missing_contact"
        elif sum(x[3] != "cancelled" and x[2] > now - 3600 for x in mine) >= 3:
            result = "limit_reached"
        else:
            result = "created"
            rows.append((session, reason, now, "open"))
        want[i] = result
    assert got == want
    assert set(want.values()) == {"created", "existing", "missing_contact", "limit_reached"}


def test_reminder_schedule_equals_a_model_of_every_minute(spark):
    """A month of minutes: at each, every open case that waited long enough is reminded, in staff hours only."""
    rng, base = random.Random(4), 1_792_022_400  # midnight in UTC
    rows = []
    for i in range(120):
        created = base + rng.randint(0, 6 * 86_400)
        claimed = rng.choice([None, created + rng.randint(60, 90_000)])
        rows.append((i, rng.choice(["urgent", "normal", "other"]), rng.choice(["open", "cancelled"]) if claimed is None else "claimed", created, claimed,
                     rng.choice([0, 0, 1, 3]), None))
    rows = [r[:6] + ((r[3] + 60 * rng.randint(1, 900)) if r[5] else None,) for r in rows]
    df = spark.createDataFrame(rows, "case_id long, urgency string, status string, created_epoch long, claimed_epoch long, escalation_count int, last_escalated_epoch long")
    until = base + 30 * 86_400
    got = sorted((r.case_id, r.escalation_count, r.reminded_epoch) for r in cases.reminder_schedule(df, until).collect())
    want = []
    for i, urgency, status, created, claimed, count, last in rows:
        if urgency == "other" or status == "cancelled":
            continue
        wait, most = cases.REMINDERS[urgency]
        since, now = last or created, (last or created) // 60 * 60
        while now <= until and count < most and (claimed is None or now < claimed):
            if 480 <= (now + 25_200) // 60 % 1440 < 1380 and now - since >= wait * 60:
                count, since = count + 1, now
                want.append((i, count, now))
            now += 60
    assert got == sorted(want) and len(want) > 60
