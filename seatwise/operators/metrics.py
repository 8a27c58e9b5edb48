"""Usage, quality and load figures, and the audit of request rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seatwise.operators.windows import upper_median

#: Requests per minute and burst allowed to one visitor, and the largest body in bytes.
LIMITS = {"site": (120, 60, None), "chat": (12, 6, 8192), "voice": (6, 3, 1_536_000)}


def usage_metrics(calls: DataFrame, keys: list[str], price_in: float | None = None, price_out: float | None = None) -> DataFrame:
    """Messages, model calls, tokens, response time and cost per key, from one row per model call.

    ``calls``: keys, execution_id, prompt_tokens, completion_tokens, seconds (of the whole execution). Prices are per
    million tokens. The median response time is the upper middle element. A call without token usage counts with 0 tokens;
    ``called`` (if there) is false in the row that stands for an execution without any call.
    """
    if not keys:
        return usage_metrics(calls.withColumn("_all", F.lit(1)), ["_all"], price_in, price_out).drop("_all")
    called = F.col("called") if "called" in calls.columns else F.lit(True)
    per_message = calls.groupBy(*keys, "execution_id").agg(
        F.count_if(called).alias("calls"), F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("tokens_in"),
        F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("tokens_out"), F.max("seconds").alias("seconds"))
    totals = per_message.groupBy(*keys).agg(
        F.count("*").alias("messages"), F.sum("calls").alias("model_calls"), F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"), F.max("seconds").alias("seconds_max"))
    median = upper_median(per_message, "seconds", keys, "seconds_median")
    out = totals.join(median, keys, "left").withColumns({
        "tokens_in_per_message": F.floor(F.col("tokens_in") / F.col("messages")),
        "tokens_out_per_message": F.floor(F.col("tokens_out") / F.col("messages"))})
    if price_in is None or price_out is None:
        return out
    cost = F.col("tokens_in") / 1e6 * price_in + F.col("tokens_out") / 1e6 * price_out
    return out.withColumn("cost", cost).withColumn("cost_per_message", F.col("cost") / F.col("messages"))


def pass_rates(results: DataFrame, cleanup_no: int = 90, cleanup_name: str = "90. cancelar por el chat (limpieza)") -> DataFrame:
    """Runs passed out of all per scenario; cleanup cancellations count together; imperfect scenarios are flagged."""
    key = F.when(F.col("scenario_no") == cleanup_no, cleanup_name).otherwise(
        F.concat(F.lpad(F.col("scenario_no").cast("string"), 2, " "), F.lit(". "), "scenario"))
    return results.groupBy(key.alias("scenario_key")).agg(
        F.sum(F.col("ok").cast("long")).alias("passed"), F.count("*").alias("total")).withColumn(
        "flagged", F.col("passed") != F.col("total"))


def run_totals(results: DataFrame) -> DataFrame:
    return results.groupBy("run_no").agg(F.sum(F.col("ok").cast("long")).alias("passed"), F.count("*").alias("total"))


def report_rows(results: DataFrame) -> DataFrame:
    """Per-scenario results as one JSON document per row, ready to be written as text lines."""
    return results.select(F.to_json(F.struct(*results.columns)).alias("value"))


def booking_load(reservations: DataFrame, keys: list[str]) -> DataFrame:
    return reservations.groupBy(*keys).agg(
        F.count("*").alias("bookings"), F.sum("people").alias("guests"),
        F.min("reservation_date").alias("first_date"), F.max("reservation_date").alias("last_date"))


def executions_between(executions: DataFrame, start: str, end: str) -> DataFrame:
    """Executions whose start, cut to whole seconds, lies in [start, end]; both are ISO texts. The test reaches the scan."""
    started = F.col("started_at")
    return executions.where((started >= F.lit(start).cast("timestamp")) & (started < F.lit(end).cast("timestamp") + F.expr("INTERVAL 1 SECOND")))


def throttle_audit(requests: DataFrame, kind: str = "chat") -> DataFrame:
    """Per visitor and minute: requests seen, requests over the limit of the kind, and bodies that are too large."""
    per_minute, _, max_bytes = LIMITS[kind]
    too_large = F.lit(False) if max_bytes is None else F.col("body_bytes") > max_bytes
    minute = (F.floor(F.col("epoch") / 60) * 60).alias("minute_epoch")
    return requests.groupBy("visitor", minute).agg(
        F.count("*").alias("requests"), F.count_if(too_large).alias("too_large")).withColumn(
        "over_limit", F.greatest(F.col("requests") - per_minute, F.lit(0).cast("long")))
