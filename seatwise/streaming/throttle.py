"""Exact token bucket per visitor as a stateful stream; ``metrics.throttle_audit`` is the per-minute batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from seatwise.operators.metrics import LIMITS


class TokenBucket(StatefulProcessor):
    """Tokens refill at the allowed rate up to the burst; a request without a token, or with too large a body, is refused."""

    def __init__(self, per_minute: int, burst: int, max_bytes: int | None):
        self.rate, self.burst, self.max_bytes = per_minute / 60.0, burst, max_bytes

    def init(self, handle) -> None:
        self.bucket = handle.getValueState("bucket", "tokens double, epoch long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tokens, last = self.bucket.get() if self.bucket.exists() else (float(self.burst), None)
        out = []
        for r in pd.concat(list(rows)).sort_values(["epoch", "event_id"]).itertuples():
            if last is not None and r.epoch > last:
                tokens = min(float(self.burst), tokens + (r.epoch - last) * self.rate)
            last = r.epoch if last is None else max(last, r.epoch)
            if tokens < 1.0:
                verdict = "rate_limited"
            else:
                tokens -= 1.0
                verdict = "too_large" if self.max_bytes is not None and r.body_bytes > self.max_bytes else "passed"
            out.append((r.event_id, key[0], verdict))
        self.bucket.update((tokens, int(last)))
        yield pd.DataFrame(out, columns=["event_id", "visitor", "verdict"])

    def close(self) -> None:
        pass


def throttle_stream(requests: DataFrame, kind: str = "chat") -> DataFrame:
    """Stream of (event_id, visitor, epoch, body_bytes) to one verdict per request."""
    return requests.groupBy("visitor").transformWithStateInPandas(
        TokenBucket(*LIMITS[kind]), "event_id long, visitor long, verdict string", "append", "none")


def throttle_windows(requests: DataFrame, kind: str = "chat", delay: str = "2 minutes") -> DataFrame:
    """Streaming audit (visitor, ts): requests per visitor and minute, emitted once the watermark has passed the minute."""
    per_minute = LIMITS[kind][0]
    return requests.withWatermark("ts", delay).groupBy("visitor", F.window("ts", "1 minute").alias("w")).agg(
        F.count("*").alias("requests")).select(
        "visitor", F.col("w.start").alias("minute"), "requests", F.greatest(F.col("requests") - per_minute, F.lit(0).cast("long")).alias("over_limit"))
