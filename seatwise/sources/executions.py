"""Execution logs as JSON files, one execution per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seatwise.operators.metrics import executions_between

SCHEMA = ("id string, startedAt string, stoppedAt string, "
          "calls array<struct<promptTokens:bigint,completionTokens:bigint>>")


def read_executions(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Executions started in [start, end] (ISO seconds), with their duration and model calls."""
    raw = spark.read.schema(SCHEMA).json(path)
    started, stopped = F.to_timestamp("startedAt"), F.to_timestamp("stoppedAt")
    rows = raw.select(
        F.col("id").alias("execution_id"), started.alias("started_at"),
        (stopped.cast("double") - started.cast("double")).alias("seconds"), "calls")
    return executions_between(rows, start, end)


def flatten_calls(executions: DataFrame) -> DataFrame:
    """One row per model call; an execution without calls keeps one row with null tokens, so that it counts as a message."""
    return executions.select("execution_id", "started_at", "seconds", F.explode_outer("calls").alias("call")).select(
        "execution_id", "started_at", "seconds", F.col("call.promptTokens").alias("prompt_tokens"),
        F.col("call.completionTokens").alias("completion_tokens"), F.col("call").isNotNull().alias("called"))


def parse_documents(documents: DataFrame, text: str = "document", node: str = "Chat Model") -> tuple[DataFrame, DataFrame]:
    """The calls of full execution documents, and the documents that cannot be used.

    A document nests its model calls below ``data.resultData.runData.<node>``, one entry per run; a run tells its tokens under ``tokenUsage`` or,
    in newer documents, under ``usage``. Fields that come, go or change their type do not break a document: what cannot be read is null.
    Calls have execution_id, started_at, seconds, call_no (from 1; null for an execution without calls), prompt_tokens and completion_tokens.
    A document is set aside, with its text and the reason, if it is no JSON (``not_json``), has no id (``no_id``) or no readable start and end
    (``no_times``).
    """
    def field(value, path, kind):
        return F.try_variant_get(value, path, kind)

    doc = F.col("_doc")
    read = documents.withColumn("_doc", F.try_parse_json(F.col(text))).withColumns({
        "execution_id": field(doc, "$.id", "string"),
        "started_at": F.try_to_timestamp(field(doc, "$.startedAt", "string")), "_stopped": F.try_to_timestamp(field(doc, "$.stoppedAt", "string"))})
    reason = (
        F.when(doc.isNull(), "not_json").when(F.col("execution_id").isNull(), "no_id")
        .when(F.col("started_at").isNull() | F.col("_stopped").isNull(), "no_times"))
    checked = read.withColumn("reason", reason)
    broken = checked.where(F.col("reason").isNotNull()).select(*documents.columns, "reason")

    def tokens(run, old, new):
        at = "$.data.ai_languageModel[0][0].json"
        return F.coalesce(field(run, f"{at}.tokenUsage.{old}", "long"), field(run, f"{at}.usage.{new}", "long"))

    runs = field(doc, f"$.data.resultData.runData['{node}']", "array<variant>")
    calls = checked.where(F.col("reason").isNull()).select(
        "execution_id", "started_at", (F.col("_stopped").cast("double") - F.col("started_at").cast("double")).alias("seconds"),
        F.posexplode_outer(runs).alias("_at", "_run"))
    return calls.select(
        "execution_id", "started_at", "seconds", (F.col("_at") + 1).alias("call_no"),
        tokens(F.col("_run"), "promptTokens", "input_tokens").alias("prompt_tokens"),
        tokens(F.col("_run"), "completionTokens", "output_tokens").alias("completion_tokens")), broken
