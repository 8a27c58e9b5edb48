"""Registered queries whose rows are decided one after another. Their SQL is the sequential model itself: a recursion that takes each
venue's (or session's) next command against the state left by the earlier ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from seatwise.operators import cases, decisions
from seatwise.plans.booking_queries import DAYNO, NOW_S, OWNED, RES, TEAM_ONLY, TODAY, WISHES, windows
from seatwise.plans.registry import Registry
from seatwise.plans.views import AS_OF, with_views

registry = Registry()
add = registry.add


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def peak(near: str, start: str, slot: str) -> str:
    """Most guests at once in [start, start + slot) among a list of (s, people), looked at where someone arrives."""
    return f"""ifnull(list_max(list_transform(list_append(list_transform(list_filter({near}, lambda o: o.s > {start} AND o.s < {start} + {slot}), lambda o: o.s), {start}),
   lambda t: ifnull(list_sum(list_transform(list_filter({near}, lambda o: o.s <= t AND t < o.s + {slot}), lambda o: o.people)), 0))), 0)"""


@add("open_cases", recursive(with_views("cases", """,
 asks AS (SELECT case_id, session_key, reason, guest_contact IS NOT NULL AS reachable, created_epoch AS e,
   row_number() OVER (PARTITION BY session_key ORDER BY created_epoch, case_id) AS step FROM cases WHERE session_key IS NOT NULL),
 walk AS (SELECT session_key, 0 AS step, 0::BIGINT AS case_id, NULL::VARCHAR AS result, (-1)::BIGINT AS existing_id,
   []::STRUCT(id BIGINT, reason VARCHAR, e BIGINT)[] AS opened FROM (SELECT DISTINCT session_key FROM asks)
  UNION ALL SELECT session_key, step, case_id, CASE WHEN twin IS NOT NULL THEN 'existing' WHEN NOT reachable THEN 'missing_contact'
    WHEN len(recent) >= 3 THEN 'limit_reached' ELSE 'created' END, ifnull(twin, -1),
   if(twin IS NULL AND reachable AND len(recent) < 3, list_append(recent, {'id': case_id, 'reason': reason, 'e': e}), recent)
  FROM (SELECT a.*, list_filter(w.opened, lambda o: o.e > a.e - 3600) AS recent,
     list_max(list_transform(list_filter(w.opened, lambda o: o.reason = a.reason AND o.e > a.e - 900), lambda o: o.id)) AS twin
    FROM walk w JOIN asks a ON a.session_key = w.session_key AND a.step = w.step + 1))
 SELECT case_id, result, existing_id FROM walk WHERE step > 0
 UNION ALL SELECT case_id, CASE WHEN guest_contact IS NULL THEN 'missing_contact' ELSE 'created' END, -1 FROM cases WHERE session_key IS NULL""")))
def open_cases(t):
    asks = t.cases.select("case_id", "session_key", "reason", "guest_contact", F.col("created_epoch").alias("epoch"))
    return cases.open_cases(asks).select("case_id", "result", F.coalesce("existing_id", F.lit(-1)).cast("long").alias("existing_id"))


@add("admit_bookings", recursive(with_views("venue_config guests reservations booking_requests opening_hours special_dates", RES + TEAM_ONLY + windows(
    "(SELECT venue_id, req_date AS d FROM booking_requests)") + f""",
 held AS (SELECT r.venue_id, channel_user_id AS identity, count(*) AS n FROM reservations r JOIN guests g USING (customer_id)
   WHERE g.channel = 'web' AND r.status <> 'cancelled' AND reservation_date >= {TODAY} GROUP BY ALL),
 made AS (SELECT venue_id, count(*) AS n FROM reservations WHERE channel = 'web' AND created_epoch BETWEEN {AS_OF} - 3599 AND {AS_OF} GROUP BY ALL),
 starts AS (SELECT venue_id, d, list({{'s': s, 'people': people}}) AS near FROM (SELECT venue_id, d, s, people FROM res
   UNION ALL SELECT venue_id, d + 1, s, people FROM res) GROUP BY ALL),
 asks AS (SELECT b.request_id, b.venue_id, req_date, {DAYNO.format(d='req_date')} * 1440 + req_min AS s, people, 'phone:' || replace(phone, ' ', '') AS identity,
   capacity, slot_min, max_per_phone, max_per_hour, ifnull(h.n, 0) AS held, ifnull(m.n, 0) AS made, ifnull(st.near, []) AS near,
   CASE WHEN c.venue_id IS NULL THEN 'unknown_venue' WHEN req_date IS NULL OR req_min IS NULL OR people IS NULL THEN 'invalid_request'
    WHEN {DAYNO.format(d='req_date')} * 1440 + req_min < {NOW_S} THEN 'past_date' WHEN req_date > {TODAY} + 90 THEN 'too_far_ahead'
    WHEN NOT ifnull(req_min BETWEEN w.open_min AND w.close_min - 30, FALSE) THEN 'outside_hours'
    WHEN team.d IS NOT NULL THEN 'team_only_event' WHEN people > max_party THEN 'party_too_large' END AS settled,
   row_number() OVER (PARTITION BY b.venue_id ORDER BY request_epoch, request_id) AS step
  FROM booking_requests b LEFT JOIN venue_config c ON c.venue_id = b.venue_id LEFT JOIN win w ON w.venue_id = b.venue_id AND w.d = req_date
  LEFT JOIN team ON team.venue_id = b.venue_id AND team.d = req_date LEFT JOIN held h ON h.venue_id = b.venue_id AND h.identity = 'phone:' || replace(phone, ' ', '')
  LEFT JOIN made m ON m.venue_id = b.venue_id LEFT JOIN starts st ON st.venue_id = b.venue_id AND st.d = req_date),
 walk AS (SELECT venue_id, 0 AS step, 0::BIGINT AS request_id, NULL::VARCHAR AS status, []::STRUCT(day DATE, s BIGINT, people BIGINT, identity VARCHAR)[] AS taken
   FROM (SELECT DISTINCT venue_id FROM asks)
  UNION ALL SELECT venue_id, step, request_id, answer, if(answer = 'confirmed', list_append(taken, {{'day': req_date, 's': s, 'people': people, 'identity': identity}}), taken)
  FROM (SELECT x.*, CASE WHEN settled IS NOT NULL THEN settled
     WHEN held + len(list_filter(taken, lambda k: k.identity = x.identity)) >= max_per_phone OR made + len(taken) >= max_per_hour THEN 'limit_reached'
     WHEN capacity - {peak('x.around', 'x.s', 'x.slot_min')} < people THEN 'no_availability' ELSE 'confirmed' END AS answer
    FROM (SELECT a.*, w.taken, list_filter(list_concat(a.near, list_transform(list_filter(w.taken, lambda k: k.day <= a.req_date), lambda k: {{'s': k.s, 'people': k.people}})),
       lambda o: o.s > a.s - a.slot_min AND o.s < a.s + a.slot_min) AS around
     FROM walk w JOIN asks a ON a.venue_id IS NOT DISTINCT FROM w.venue_id AND a.step = w.step + 1) x))
 SELECT request_id, status, if(status = 'confirmed', 'RSV-' || upper(substr(sha256('request:' || request_id), 1, 10)), '') AS confirmation_code
 FROM walk WHERE step > 0""")))
def admit_bookings(t):
    return decisions.admit_bookings(t.booking_requests, t.reservations, t.guests, t.venue_config, t.opening_hours, t.special_dates, AS_OF).select(
        "request_id", "status", F.coalesce("confirmation_code", F.lit("")).alias("confirmation_code"))


#: For each command the booking that its caller may change as the table stands, then a walk over all commands of a venue: state holds every
#: booking's present values ('b'), each venue's last step ('v') and each command's answer ('c').
APPLIED = recursive(with_views("venue_config guests reservations opening_hours special_dates change_commands change_log",
                               TEAM_ONLY + OWNED.replace("{commands}", "change_commands") + WISHES + windows(
    "(SELECT venue_id, d FROM (SELECT venue_id, w_date AS d FROM wishes JOIN named USING (command_id) UNION SELECT venue_id, reservation_date FROM reservations))") + f""",
 counts AS (SELECT reservation_id, count(*) AS last_day FROM change_log WHERE action = 'modified' AND created_epoch > {AS_OF} - 86400 GROUP BY 1),
 orders AS (SELECT n.venue_id, n.reservation_id, w.*, capacity, slot_min, max_party, max_changes_day, ifnull(last_day, 0) AS last_day,
   row_number() OVER (PARTITION BY n.venue_id ORDER BY k.command_epoch, w.command_id) AS step
  FROM wishes w JOIN named n USING (command_id) JOIN change_commands k USING (command_id) JOIN venue_config c ON c.venue_id = n.venue_id
  LEFT JOIN counts USING (reservation_id) WHERE n.status <> 'cancelled'),
 st(kind, id, venue_id, step, d, m, people, zone, note, changes, status) USING KEY (kind, id) AS (
  SELECT 'b' AS kind, reservation_id, venue_id, 0::BIGINT, reservation_date, reservation_min::BIGINT, people::BIGINT, zone, special_requests, 0::BIGINT, NULL::VARCHAR FROM reservations
   WHERE status <> 'cancelled' AND reservation_date >= {TODAY} - 1
  UNION ALL SELECT DISTINCT 'v', venue_id, venue_id, 0, NULL::DATE, NULL, NULL, NULL, NULL, 0, NULL FROM orders
  UNION (WITH turn AS (SELECT o.*, b.d, b.m, b.people, b.zone, b.note, b.changes, ifnull(w_date, b.d) AS n_d, ifnull(w_min, b.m) AS n_m, ifnull(w_people, b.people) AS n_people,
      ifnull(w_zone, b.zone) AS n_zone, if(extra IS NULL, b.note, array_to_string(list_filter([b.note, extra], lambda t: t <> ''), '; ')) AS n_note
     FROM st v JOIN orders o ON o.venue_id = v.venue_id AND o.step = v.step + 1 JOIN recurring.st b ON b.kind = 'b' AND b.id = o.reservation_id WHERE v.kind = 'v'),
    placed AS (SELECT t.*, {DAYNO.format(d='n_d')} * 1440 + n_m AS s, (SELECT list({{'s': {DAYNO.format(d='x.d')} * 1440 + x.m, 'people': x.people}}) FROM recurring.st x
      WHERE x.kind = 'b' AND x.venue_id = t.venue_id AND x.id <> t.reservation_id AND x.d BETWEEN t.n_d - 1 AND t.n_d) AS near FROM turn t),
    answered AS (SELECT p.*, CASE WHEN unreadable THEN 'invalid_request'
      WHEN n_d = p.d AND n_m = m AND n_people = people AND n_zone = zone AND n_note IS NOT DISTINCT FROM note THEN 'no_changes'
      WHEN s < {NOW_S} THEN 'past_date' WHEN n_d > {TODAY} + 90 THEN 'too_far_ahead'
      WHEN NOT ifnull(n_m BETWEEN open_min AND close_min - 30, FALSE) THEN 'outside_hours' WHEN team.d IS NOT NULL THEN 'team_only_event'
      WHEN n_people > max_party THEN 'party_too_large' WHEN last_day + changes >= max_changes_day THEN 'limit_reached'
      WHEN capacity - {peak('p.near', 'p.s', 'p.slot_min')} < n_people THEN 'no_availability' ELSE 'modified' END AS answer
     FROM placed p LEFT JOIN win w ON w.venue_id = p.venue_id AND w.d = n_d LEFT JOIN team ON team.venue_id = p.venue_id AND team.d = n_d)
   SELECT 'v' AS kind, venue_id AS id, venue_id, step, NULL::DATE AS d, NULL AS m, NULL AS people, NULL AS zone, NULL AS note, 0 AS changes, NULL AS status FROM answered
   UNION ALL SELECT 'c', command_id, venue_id, reservation_id, n_d, n_m, n_people, n_zone, n_note, changes + 1, answer FROM answered
   UNION ALL SELECT 'b', reservation_id, venue_id, 0, n_d, n_m, n_people, n_zone, n_note, changes + 1, NULL FROM answered WHERE answer = 'modified'))"""))


@add("apply_modifications", APPLIED + """
 SELECT k.command_id, a.step AS reservation_id, ifnull(a.status, 'not_found') AS status, if(done, a.d, NULL) AS n_date, if(done, a.m, NULL)::INTEGER AS n_min,
  if(done, a.people, NULL)::INTEGER AS n_people, if(done, a.zone, NULL) AS n_zone, if(done, a.note, NULL) AS n_requests, if(done, a.changes, NULL) AS change_no
 FROM change_commands k LEFT JOIN (SELECT *, status = 'modified' AS done FROM st WHERE kind = 'c') a ON a.id = k.command_id""")
def apply_modifications(t):
    return applied(t)


def applied(t):
    return decisions.apply_modifications(t.change_commands, t.reservations, t.guests, t.venue_config, t.opening_hours, t.special_dates,
                                         t.change_log, AS_OF)


@add("modified_snapshot", APPLIED + """
 SELECT r.reservation_id, ifnull(b.d, r.reservation_date) AS reservation_date, ifnull(b.m, r.reservation_min)::INTEGER AS reservation_min,
  ifnull(b.people, r.people)::INTEGER AS people, if(b.id IS NULL, r.zone, b.zone) AS zone, if(b.id IS NULL, r.special_requests, b.note) AS special_requests
 FROM reservations r LEFT JOIN (SELECT * FROM st WHERE kind = 'b') b ON b.id = r.reservation_id""")
def modified_snapshot(t):
    return decisions.modified_snapshot(t.reservations, applied(t)).select(
        "reservation_id", "reservation_date", "reservation_min", "people", "zone", "special_requests")
