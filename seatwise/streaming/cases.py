"""Streaming forms of case opening and staff reminders: keyed state, event time, watermarks.

State is small by rule: a session keeps the requests the watermark has not passed yet and the cases of its last hour (three at most), and
nothing once that hour is over; a case keeps its reminder count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from seatwise.operators.cases import DEDUP_SECONDS, LIMIT_CASES, LIMIT_SECONDS

_OPENED = "session_key long, case_id long, result string, existing_id long"


class OpenCases(StatefulProcessor):
    """Holds requests back until the watermark has passed them and decides them in order of (epoch, case_id) then."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "epoch long, case_id long, reason string, guest_contact string")
        self.opened = handle.getValueState("opened", "epochs array<long>, reasons array<string>, ids array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, late = timerValues.getCurrentWatermarkInMs(), []
        for r in pd.concat(list(rows)).itertuples():
            if r.epoch * 1000 < passed:
                late.append((key[0], r.case_id, "late", -1))
            else:
                self.waiting.appendValue((int(r.epoch), int(r.case_id), r.reason, None if pd.isna(r.guest_contact) else r.guest_contact))
                self.handle.registerTimer(int(r.epoch) * 1000 + 1)
        yield pd.DataFrame(late, columns=["session_key", "case_id", "result", "existing_id"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = [tuple(w) for w in self.waiting.get()] if self.waiting.exists() else []
        due = sorted(w for w in held if w[0] * 1000 < passed)
        opened = list(zip(*self.opened.get(), strict=True)) if self.opened.exists() else []
        out = []
        for epoch, case_id, reason, contact in due:
            opened = [c for c in opened if c[0] > epoch - LIMIT_SECONDS]
            same = [c[2] for c in opened if c[1] == reason and c[0] > epoch - DEDUP_SECONDS]
            if same:
                out.append((key[0], case_id, "existing", max(same)))
            elif contact is None:
                out.append((key[0], case_id, "missing_contact", -1))
            elif len(opened) >= LIMIT_CASES:
                out.append((key[0], case_id, "limit_reached", -1))
            else:
                opened.append((epoch, reason, case_id))
                out.append((key[0], case_id, "created", -1))
        self._keep([w for w in held if w[0] * 1000 >= passed], [c for c in opened if (c[0] + LIMIT_SECONDS) * 1000 >= passed], bool(due))
        yield pd.DataFrame(out, columns=["session_key", "case_id", "result", "existing_id"])

    def _keep(self, waiting: list, opened: list, decided: bool) -> None:
        """Only what can still matter stays; the last opened case leaves an hour after it was opened."""
        if decided:
            self.waiting.clear()
            if waiting:
                self.waiting.put(waiting)
        if opened:
            self.opened.update(tuple(list(c) for c in zip(*opened, strict=True)))
            self.handle.registerTimer((max(c[0] for c in opened) + LIMIT_SECONDS) * 1000 + 1)
        else:
            self.opened.clear()

    def close(self) -> None:
        pass


def open_cases_stream(requests: DataFrame, delay: str = "5 minutes") -> DataFrame:
    """Stream of (case_id, session_key, reason, guest_contact, epoch) to one result per request.

    A request is decided when the watermark, ``delay`` behind the latest request, has passed it, so rows may come out of order by up to
    ``delay``; one that comes later still gets the result ``late`` and no decision, for the caller to set aside. Requests without a
    session need no state: they are created, or lack a contact.
    """
    timed = requests.withColumn("ts", F.timestamp_seconds("epoch")).withWatermark("ts", delay)
    # without its time column the stream is not cut off at the watermark, so that late rows reach the processor
    keyed = timed.where(F.col("session_key").isNotNull()).select("case_id", "session_key", "reason", "guest_contact", "epoch")
    decided = keyed.groupBy("session_key").transformWithStateInPandas(OpenCases(), _OPENED, "append", "eventTime")
    result = F.when(F.col("guest_contact").isNull(), "missing_contact").otherwise("created")
    free = requests.where(F.col("session_key").isNull()).select(
        F.col("session_key").cast("long").alias("session_key"), "case_id", result.alias("result"), F.lit(-1).cast("long").alias("existing_id"))
    return decided.unionByName(free)


_REMINDED = "case_id long, urgency string, escalation_count int, max_reminders int, minutes_open int"
MINUTE_MS = 60_000


def next_reminder_ms(due_ms: int, offset_minutes: int, start: int = 480, end: int = 1380) -> int:
    """``due_ms``, or the next opening of staff hours when it falls outside them."""
    local = due_ms + offset_minutes * MINUTE_MS
    minute = local // MINUTE_MS % 1440
    if start <= minute < end:
        return due_ms
    days = 0 if minute < start else 1
    return (local // (1440 * MINUTE_MS) + days) * 1440 * MINUTE_MS + start * MINUTE_MS - offset_minutes * MINUTE_MS


class Reminders(StatefulProcessor):
    """Timers on event time: urgent every 5 minutes at most 3 times, normal every 20 at most twice, until claimed."""

    def __init__(self, offset_minutes: int = 420):
        self.offset_minutes = offset_minutes

    def init(self, handle) -> None:
        self.handle = handle
        self.case = handle.getValueState("case", "urgency string, created_ms long, reminders int")

    def _arm(self, after_ms: int, urgency: str) -> None:
        wait = 5 if urgency == "urgent" else 20
        self.handle.registerTimer(next_reminder_ms(after_ms + wait * MINUTE_MS, self.offset_minutes))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for r in pd.concat(list(rows)).sort_values(["epoch", "seq"]).itertuples():
            if r.event == "created" and not self.case.exists():
                self.case.update((r.urgency, int(r.epoch) * 1000, 0))
                self._arm(int(r.epoch) * 1000, r.urgency)
            elif r.event in ("claimed", "cancelled", "resolved", "notify_failed"):
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.case.update(("done", 0, 99))
        yield pd.DataFrame(columns=["case_id", "urgency", "escalation_count", "max_reminders", "minutes_open"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        urgency, created_ms, count = self.case.get()
        most = 3 if urgency == "urgent" else 2
        now = expiredTimerInfo.getExpiryTimeInMs()
        out = []
        if urgency != "done" and count < most:
            out.append((key[0], urgency, count + 1, most, (now - created_ms) // MINUTE_MS))
            self.case.update((urgency, created_ms, count + 1))
            if count + 1 < most:
                self._arm(now, urgency)
        yield pd.DataFrame(out, columns=["case_id", "urgency", "escalation_count", "max_reminders", "minutes_open"])

    def close(self) -> None:
        pass


def reminder_stream(case_events: DataFrame, delay: str = "1 minute", offset_minutes: int = 420) -> DataFrame:
    """Stream of case events (case_id, event, urgency, epoch, seq, ts) to the reminders that fall due as time passes."""
    return case_events.withWatermark("ts", delay).groupBy("case_id").transformWithStateInPandas(
        Reminders(offset_minutes), _REMINDED, "append", "eventTime")
