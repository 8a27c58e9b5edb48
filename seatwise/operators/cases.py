"""Staff cases: normalization, deduplication, claiming, reminders, state and service level.

Times are whole seconds since the epoch.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from seatwise.functions import lexicon
from seatwise.functions.scalars import clip, epoch_ts, nullif_blank, within_hours
from seatwise.operators.windows import with_rolling_latest
from seatwise.session import spread

DEDUP_SECONDS, LIMIT_SECONDS, LIMIT_CASES = 900, 3600, 3


def normalize_case(raw: DataFrame, epoch: str = "epoch", tz: str = "Asia/Bangkok") -> DataFrame:
    """Defaults for unknown words, blanks to null, texts clipped, code upper and language lower case, staff hours flag."""
    def one_of(c, allowed, default):
        return F.when(F.col(c).isin(*allowed), F.col(c)).otherwise(default)

    return raw.withColumns({
        "channel": one_of("channel", lexicon.CHANNELS, "web"),
        "session_key": nullif_blank(F.col("session_key")),
        "reason": one_of("reason", lexicon.CASE_REASONS, "wants_human"),
        "urgency": one_of("urgency", ["urgent"], "normal"),
        "summary": clip(F.coalesce(nullif_blank(F.col("summary")), F.lit(lexicon.LANGUAGE_SUMMARY_PLACEHOLDER)), 1000),
        "guest_name": clip(nullif_blank(F.col("guest_name")), 120),
        "guest_contact": clip(nullif_blank(F.col("guest_contact")), 200),
        "confirmation_code": clip(F.upper(nullif_blank(F.col("confirmation_code"))), 20),
        "language": clip(F.lower(nullif_blank(F.col("language"))), 10),
        "within_hours": within_hours(epoch_ts(F.col(epoch)), tz),
    })


def latest_open_case(requests: DataFrame, cases: DataFrame, epoch: str = "epoch") -> DataFrame:
    """``requests`` plus the newest open or claimed case of the same session and reason from the last 15 minutes."""
    live = cases.where(F.col("status").isin("open", "claimed"))
    return with_rolling_latest(requests, live, ["session_key", "reason"], DEDUP_SECONDS, "case_id", "existing_id", epoch, "created_epoch")


# ---------------------------------------------------------------------------------------------------- opening cases

def _created_in_order(batches):
    """Which candidates become cases, for rows sorted by (session, epoch, order): a session's last hour is all the state."""
    session, by_reason, recent = None, {}, deque()
    for batch in batches:
        made = []
        for key, now, reason, case_id, seeds, open_seeds in zip(*(batch[c] for c in (
                "session_key", "epoch", "reason", "case_id", "seeds", "open_seeds"))):
            if key != session:
                session, by_reason, recent = key, {}, deque()
            while recent and recent[0] <= now - LIMIT_SECONDS:
                recent.popleft()
            if seeds >= 0:  # cases known before this batch
                recent.extend([now] * int(seeds))
                if open_seeds > 0:
                    by_reason[reason] = now
                continue
            if by_reason.get(reason, now - DEDUP_SECONDS) > now - DEDUP_SECONDS or len(recent) >= LIMIT_CASES:
                continue
            by_reason[reason] = now
            recent.append(now)
            made.append((key, reason, now, case_id))
        yield pd.DataFrame(made, columns=["session_key", "reason", "created_epoch", "case_id"])


def created_cases(requests: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The requests (case_id, session_key, reason, guest_contact, epoch) that open a new case, in order of (epoch, case_id).

    Within one second only the first request with a contact can open a case per session and reason: afterwards it exists,
    or what stopped it still holds. So each session comes down to one row per reason and second before it is walked.
    """
    first = requests.where(F.col("session_key").isNotNull() & F.col("guest_contact").isNotNull()).groupBy(
        "session_key", "epoch", "reason").agg(F.min("case_id").alias("case_id"))
    rows = first.select("session_key", "epoch", "reason", "case_id", F.lit(-1).cast("long").alias("seeds"),
                        F.lit(0).cast("long").alias("open_seeds"), F.lit(1).alias("turn"))
    if known is not None:
        seeds = known.where(F.col("session_key").isNotNull() & (F.col("status") != "cancelled")).groupBy(
            "session_key", F.col("created_epoch").alias("epoch"), "reason").agg(
            F.max("case_id").alias("case_id"), F.count("*").alias("seeds"),
            F.count_if(F.col("status").isin("open", "claimed")).alias("open_seeds"))
        rows = rows.unionByName(seeds.withColumn("turn", F.lit(0)))
    ordered = spread(rows, "session_key").sortWithinPartitions("session_key", "epoch", "turn", "case_id")
    kinds = dict(requests.dtypes)
    return ordered.mapInPandas(
        _created_in_order, f"session_key {kinds['session_key']}, reason string, created_epoch long, case_id {kinds['case_id']}")


def open_cases(requests: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per request with ``result``: created, existing (and which), missing_contact or limit_reached.

    Requests without a session are never deduplicated or limited.
    """
    made = created_cases(requests, known).select("session_key", "reason", "case_id", "created_epoch")
    live = made
    if known is not None:
        live = made.unionByName(known.where(F.col("status").isin("open", "claimed")).select(*made.columns))
    # Cases of one second and reason: the request that opened it comes before the ones that find it.
    found = with_rolling_latest(requests, live, ["session_key", "reason"], DEDUP_SECONDS, "case_id", "live_id", "epoch", "created_epoch")
    same_second = made.select("session_key", "reason", F.col("created_epoch").alias("epoch"), F.col("case_id").alias("opened_id"))
    judged = found.join(same_second, ["session_key", "reason", "epoch"], "left")
    before = F.col("live_id").isNotNull() & (F.col("opened_id").isNull() | (F.col("opened_id") < F.col("case_id")))
    result = (
        F.when(F.col("opened_id") == F.col("case_id"), "created")
        .when(before, "existing")
        .when(F.col("guest_contact").isNull(), "missing_contact")
        .when(F.col("session_key").isNull(), "created")
        .otherwise("limit_reached"))
    return judged.withColumn("result", result).withColumn(
        "existing_id", F.when(F.col("result") == "existing", F.col("live_id"))).drop("live_id", "opened_id")


# -------------------------------------------------------------------------------------------------------- claiming

def parse_claim_click(events: DataFrame, default_name: str = "Equipo") -> DataFrame:
    """Button presses that claim a case; anything else is dropped. The name is first and last, else @username."""
    full = F.concat_ws(" ", F.when(F.col("first_name") != "", F.col("first_name")), F.when(F.col("last_name") != "", F.col("last_name")))
    handle = F.when(F.col("username") != "", F.concat(F.lit("@"), "username"))
    return events.where(F.col("data").rlike(r"^claim:(\d+)$")).withColumn(
        "case_id", F.regexp_extract("data", r"^claim:(\d+)$", 1).try_cast("long")).withColumn(
        "staff_name", F.coalesce(F.when(full != "", full), handle, F.lit(default_name)))


def claim_cases(clicks: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per click: claimed (the first on an open case, in its own chat), already (and by whom) or not_found."""
    known = cases.select("case_id", F.col("staff_chat_id").alias("chat_id"), "status", F.col("claimed_by_name").alias("held_by"),
                         F.col("claimed_epoch").alias("held_since"))
    named = clicks.withColumn("staff_name", clip(F.col("staff_name"), 80)).join(known, ["case_id", "chat_id"], "left")
    winners = named.where(F.col("status") == "open").groupBy("case_id").agg(
        F.min_by(F.struct("click_id", "staff_name", "clicked_epoch"), F.struct("clicked_epoch", "click_id")).alias("first"))
    result = (
        F.when(F.col("status").isNull(), "not_found")
        .when(F.col("first.click_id") == F.col("click_id"), "claimed")
        .otherwise("already"))
    known_case = F.col("status").isNotNull()
    return named.join(winners, "case_id", "left").withColumns({
        "result": result,
        "claimed_by_name": F.when(known_case, F.coalesce("first.staff_name", "held_by")),
        "claimed_epoch": F.when(known_case, F.coalesce("first.clicked_epoch", "held_since")),
    }).drop("first", "held_by", "held_since")


def claimed_snapshot(cases: DataFrame, claims: DataFrame) -> DataFrame:
    won = claims.where(F.col("result") == "claimed").select(
        "case_id", F.col("claimed_by_name").alias("_name"), F.col("claimed_epoch").alias("_at"))
    hit = F.col("_at").isNotNull()
    return cases.join(won, "case_id", "left").withColumns({
        "status": F.when(hit, "claimed").otherwise(F.col("status")),
        "claimed_by_name": F.coalesce("_name", "claimed_by_name"),
        "claimed_epoch": F.coalesce("_at", "claimed_epoch")}).drop("_name", "_at")


# ------------------------------------------------------------------------------------------------ reminders and state

def reminder_rule(as_of: Column) -> Column:
    """Whether an open case is due: urgent every 5 minutes at most 3 times, normal every 20 minutes at most twice."""
    since = F.coalesce(F.col("last_escalated_epoch"), F.col("created_epoch"))
    urgent = (F.col("urgency") == "urgent") & (F.col("escalation_count") < 3) & (since <= as_of - 300)
    normal = (F.col("urgency") == "normal") & (F.col("escalation_count") < 2) & (since <= as_of - 1200)
    return (F.col("status") == "open") & (urgent | normal)


def due_reminders(cases: DataFrame, as_of: int, tz: str = "Asia/Bangkok") -> DataFrame:
    """Cases to remind staff of at this tick, with the counter already advanced; none outside staff hours."""
    now = F.lit(as_of).cast("long")
    return cases.where(within_hours(epoch_ts(now), tz) & reminder_rule(now)).withColumns({
        "escalation_count": F.col("escalation_count") + 1,
        "last_escalated_epoch": now,
        "max_reminders": F.when(F.col("urgency") == "urgent", 3).otherwise(2),
        "minutes_open": F.floor((now - F.col("created_epoch")) / 60).cast("int"),
    })


#: Minutes between reminders and how many there are, by urgency.
REMINDERS = {"urgent": (5, 3), "normal": (20, 2)}


def next_tick(due: Column, tz: Column | str, start: int = 480, end: int = 1380) -> Column:
    """The first whole minute at or after ``due`` (epoch seconds) that lies in staff hours: calendar arithmetic on the local clock."""
    tick = (F.ceil(due / 60) * 60).cast("long")
    local = F.from_utc_timestamp(epoch_ts(tick), tz)
    minute = F.hour(local) * 60 + F.minute(local)
    opening = F.date_add(F.to_date(local), F.when(minute < start, 0).otherwise(1)).cast("timestamp") + F.make_dt_interval(mins=F.lit(start))
    return F.when((minute >= start) & (minute < end), tick).otherwise(F.unix_timestamp(F.to_utc_timestamp(opening, tz)))


def reminder_schedule(cases: DataFrame, until: int, tz: str = "Asia/Bangkok") -> DataFrame:
    """Every reminder that falls due up to ``until``, for all cases at once: case_id, urgency, escalation_count, max_reminders,
    reminded_epoch and minutes_open.

    The reminders of a case follow from each other: the next is due a wait after the last one (or after the case was opened), at the
    next minute in staff hours; there are as many as the urgency allows. A case's reminders end when it is
    claimed; one that is cancelled or resolved has none. ``escalation_count`` and ``last_escalated_epoch`` say what happened before.
    """
    def by_urgency(which):
        return F.when(F.col("urgency") == "urgent", REMINDERS["urgent"][which]).otherwise(REMINDERS["normal"][which])

    most, wait = by_urgency(1), by_urgency(0) * 60
    first = F.array(F.coalesce("last_escalated_epoch", "created_epoch").cast("long"))
    times = F.aggregate(F.sequence(F.lit(1), most), first, lambda done, _: F.concat(done, F.array(next_tick(F.element_at(done, -1) + wait, tz))))
    known = cases.where(F.col("status").isin("open", "claimed") & F.col("urgency").isin(*REMINDERS))
    planned = known.withColumn("max_reminders", most).select(
        "case_id", "urgency", "max_reminders", "created_epoch", "claimed_epoch", "escalation_count", F.posexplode(times).alias("further", "reminded_epoch"))
    return planned.where("further > 0").withColumn("escalation_count", (F.col("escalation_count") + F.col("further")).cast("int")).where(
        (F.col("escalation_count") <= F.col("max_reminders")) & (F.col("reminded_epoch") <= until)
        & (F.col("claimed_epoch").isNull() | (F.col("reminded_epoch") < F.col("claimed_epoch")))).select(
        "case_id", "urgency", "escalation_count", "max_reminders", "reminded_epoch",
        F.floor((F.col("reminded_epoch") - F.col("created_epoch")) / 60).cast("int").alias("minutes_open"))


def reminded_snapshot(cases: DataFrame, due: DataFrame) -> DataFrame:
    hit = due.select("case_id", F.col("escalation_count").alias("_n"), F.col("last_escalated_epoch").alias("_at"))
    return cases.join(hit, "case_id", "left").withColumns({
        "escalation_count": F.coalesce("_n", "escalation_count"),
        "last_escalated_epoch": F.coalesce("_at", "last_escalated_epoch")}).drop("_n", "_at")


def notification_outcomes(cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Cases after the staff message was tried: a failure cancels the case, a success stores the message id.

    The last outcome by (epoch, seq) counts; ``seq`` tells apart outcomes of one second.
    """
    last = outcomes.groupBy("case_id").agg(F.max_by(F.struct("ok", "message_id"), F.struct("epoch", "seq")).alias("_last"))
    tried = F.col("_last").isNotNull()
    return cases.join(last, "case_id", "left").withColumns({
        "status": F.when(tried & ~F.col("_last.ok"), "cancelled").otherwise(F.col("status")),
        "staff_message_id": F.when(tried & F.col("_last.ok"), F.col("_last.message_id")),
    }).drop("_last")


def case_state(events: DataFrame) -> DataFrame:
    """Latest status per case from its events, and the last staff message id; order is (epoch, seq)."""
    at = F.struct("epoch", "seq")
    status = F.when(F.col("event") == "created", "open").when(F.col("event") == "notify_failed", "cancelled").when(
        F.col("event").isin("claimed", "resolved", "cancelled"), F.col("event"))
    changing = F.when(status.isNotNull(), at)
    return events.groupBy("case_id").agg(
        F.coalesce(F.max_by(status, changing), F.lit("open")).alias("status"),
        F.max_by("message_id", F.when(F.col("message_id").isNotNull(), at)).alias("staff_message_id"),
        F.max("epoch").alias("last_epoch"))


def case_sla(cases: DataFrame, keys: list[str], minutes: int = 30, tz: str = "Asia/Bangkok") -> DataFrame:
    """Cases raised in staff hours: how many, and the share claimed in less than ``minutes``."""
    in_time = F.coalesce((F.col("claimed_epoch") - F.col("created_epoch")) < minutes * 60, F.lit(False))
    return cases.where(within_hours(epoch_ts(F.col("created_epoch")), tz)).groupBy(*keys).agg(
        F.count("*").alias("cases"), F.count_if(in_time).alias("claimed_in_time"),
        F.avg(in_time.cast("double")).alias("share_in_time"))
