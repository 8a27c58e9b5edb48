"""Registered queries on the tables as they are after a batch was applied, and on documents of executions."""

from __future__ import annotations

from pyspark.sql import functions as F

from seatwise.operators import cases, changes, quality
from seatwise.plans.case_queries import CLICKS, CONFIRM_VIEWS, CONFIRMED, DUE, PATIENCE, confirmations
from seatwise.plans.registry import Registry
from seatwise.plans.views import AS_OF, CASES_AS_OF, with_views
from seatwise.sources.executions import parse_documents

registry = Registry()
add = registry.add

SENT = CONFIRMED + ", sends AS (SELECT * FROM decided WHERE result = 'ok')"


@add("confirmed_snapshot", with_views(CONFIRM_VIEWS, SENT + f"""
 SELECT r.reservation_id, if(s.command_id IS NULL, r.email_sent_epoch, {AS_OF}) AS email_sent_epoch, ifnull(s.address, r.email_to) AS email_to
 FROM reservations r LEFT JOIN sends s ON s.reservation_id = r.reservation_id"""))
def confirmed_snapshot(t):
    return confirmed(t).select("reservation_id", "email_sent_epoch", "email_to")


def confirmed(t):
    return changes.confirmed_snapshot(t.reservations, confirmations(t), AS_OF)


@add("customers_with_address", with_views(CONFIRM_VIEWS, SENT + """
 SELECT g.customer_id, ifnull(last, email) AS email FROM guests g LEFT JOIN (SELECT customer_id, arg_max(address, command_id) AS last FROM sends GROUP BY 1) s
  ON s.customer_id = g.customer_id"""))
def customers_with_address(t):
    return changes.customers_with_address(t.guests, confirmations(t)).select("customer_id", "email")


@add("release_claims", with_views(CONFIRM_VIEWS, SENT + f"""
 SELECT r.reservation_id, CASE WHEN s.command_id IS NULL THEN r.email_sent_epoch WHEN s.command_id % 4 <> 2 THEN {AS_OF} END AS email_sent_epoch,
  CASE WHEN s.command_id IS NULL THEN r.email_to WHEN s.command_id % 4 <> 2 THEN s.address END AS email_to
 FROM reservations r LEFT JOIN sends s ON s.reservation_id = r.reservation_id"""))
def release_claims(t):
    """The messages of some claims fail afterwards, those of commands that leave 2 by 4."""
    failed = confirmations(t).where((F.col("status") == "ok") & (F.col("command_id") % 4 == 2))
    return changes.release_claims(confirmed(t), failed).select("reservation_id", "email_sent_epoch", "email_to")


@add("claimed_snapshot", with_views("cases claim_clicks", CLICKS + """,
 won AS (SELECT c.case_id, arg_min({'who': staff_name, 'at': clicked_epoch}, {'e': clicked_epoch, 'k': click_id}) AS w
  FROM clicks k JOIN cases c ON c.case_id = k.case_id AND c.staff_chat_id = k.chat_id WHERE status = 'open' GROUP BY 1)
 SELECT c.case_id, if(w IS NULL, status, 'claimed') AS status, ifnull(w.who, claimed_by_name) AS claimed_by_name, ifnull(w.at, claimed_epoch) AS claimed_epoch
 FROM cases c LEFT JOIN won ON won.case_id = c.case_id"""))
def claimed_snapshot(t):
    claims = cases.claim_cases(cases.parse_claim_click(t.claim_clicks), t.cases)
    return cases.claimed_snapshot(t.cases, claims).select("case_id", "status", "claimed_by_name", "claimed_epoch")


@add("reminded_snapshot", with_views("cases", DUE + f"""
 SELECT case_id, c.escalation_count + (d.n IS NOT NULL)::INTEGER AS escalation_count, if(d.n IS NULL, c.last_escalated_epoch, {CASES_AS_OF}) AS last_escalated_epoch
 FROM cases c LEFT JOIN due d USING (case_id)"""))
def reminded_snapshot(t):
    return cases.reminded_snapshot(t.cases, cases.due_reminders(t.cases, CASES_AS_OF)).select("case_id", "escalation_count", "last_escalated_epoch")


#: The minutes of staff hours around the cases; the next reminder is the first of them at or after the wait, found by an as-of join.
TICKS = """, ticks AS (SELECT m FROM (SELECT unnest(range(lo - lo % 60, hi + 3 * 86400, 60)) AS m FROM (SELECT min(created_epoch) AS lo, max(created_epoch) AS hi FROM cases))
  WHERE (m + 25200) % 86400 >= 28800 AND (m + 25200) % 86400 < 82800),
 asked AS (SELECT case_id, urgency, created_epoch, claimed_epoch, escalation_count AS done, ifnull(last_escalated_epoch, created_epoch) AS since, 60 * minutes AS wait, max_reminders
  FROM cases JOIN {patience} USING (urgency) WHERE status IN ('open', 'claimed'))"""


def step(name: str, of: str) -> str:
    return f", {name} AS (SELECT a.* REPLACE (m AS since, done + 1 AS done) FROM {of} a ASOF JOIN ticks k ON a.since + a.wait <= k.m)"


@add("reminder_schedule", with_views("cases", TICKS.format(patience=PATIENCE) + step("r1", "asked") + step("r2", "r1") + step("r3", "r2") + f"""
 SELECT case_id, urgency, done::INTEGER AS escalation_count, max_reminders, since AS reminded_epoch, ((since - created_epoch) // 60)::INTEGER AS minutes_open
 FROM (FROM r1 UNION ALL FROM r2 UNION ALL FROM r3) WHERE done <= max_reminders AND since <= {CASES_AS_OF + 86400} AND since < ifnull(claimed_epoch, since + 1)"""))
def reminder_schedule(t):
    return cases.reminder_schedule(t.cases, CASES_AS_OF + 86400)


@add("guarded_delete_survivors", with_views("reservations guests change_log", """,
 doomed AS (SELECT reservation_id, customer_id FROM reservations WHERE customer_id % 10 = 3)
 SELECT 'change_log' AS table_name, count(*) AS rows_left, CAST(sum(reservation_id) AS BIGINT) AS id_sum FROM change_log WHERE reservation_id NOT IN (SELECT reservation_id FROM doomed)
 UNION ALL SELECT 'reservations', count(*), CAST(sum(reservation_id) AS BIGINT) FROM reservations WHERE reservation_id NOT IN (SELECT reservation_id FROM doomed)
 UNION ALL SELECT 'customers', count(*), CAST(sum(customer_id) AS BIGINT) FROM guests WHERE customer_id NOT IN (SELECT customer_id FROM doomed)"""))
def guarded_delete_survivors(t):
    """All bookings of some customers go, with those customers; the guard knows how many customers that must be."""
    listed = t.reservations.where(F.col("customer_id") % 10 == 3)
    left = quality.guarded_delete({"change_log": t.change_log, "reservations": t.reservations, "customers": t.guests},
                                  listed.select("reservation_id", "confirmation_code"), listed.select("customer_id").distinct().count())
    keys = {"change_log": "reservation_id", "reservations": "reservation_id", "customers": "customer_id"}
    sums = [left[name].agg(F.count("*").alias("rows_left"), F.sum(key).alias("id_sum")).select(F.lit(name).alias("table_name"), "rows_left", "id_sum")
            for name, key in keys.items()]
    return sums[0].unionByName(sums[1]).unionByName(sums[2])


@add("execution_calls", """
SELECT concat(l_orderkey, '-', l_linenumber) AS execution_id, epoch(TIMESTAMP '2026-10-15 10:00:00')::BIGINT AS started_epoch, (l_orderkey % 60)::DOUBLE AS seconds,
 if(l_linenumber = 4, NULL, n)::INTEGER AS call_no, if(l_linenumber < 4, if(n = 1, l_partkey, 7), NULL) AS prompt_tokens,
 if(l_linenumber < 4 AND n = 1, l_suppkey, NULL) AS completion_tokens
FROM lineitem, (VALUES (1), (2)) calls(n) WHERE l_linenumber < 4 OR (l_linenumber = 4 AND n = 1)""")
def execution_calls(t):
    calls = parse_documents(t.execution_documents)[0]
    return calls.withColumn("started_epoch", F.unix_timestamp("started_at")).drop("started_at")


@add("broken_executions", """
SELECT l_orderkey * 10 + l_linenumber AS document_no, CASE l_linenumber WHEN 5 THEN 'no_times' WHEN 6 THEN 'no_id' ELSE 'not_json' END AS reason
FROM lineitem WHERE l_linenumber > 4""")
def broken_executions(t):
    return parse_documents(t.execution_documents)[1].select("document_no", "reason")
