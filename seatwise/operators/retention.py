"""Data retention: what is old enough to go, and what is left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

DAY_SECONDS = 86_400


def session_only_customers(customers: DataFrame, as_of: int, days: int) -> DataFrame:
    """Web visitors without phone, e-mail, name or consent that have been idle for more than ``days``."""
    blank = F.col("phone").isNull() & F.col("email").isNull() & (F.coalesce("name", F.lit("")) == "")
    idle = F.coalesce("updated_epoch", "created_epoch") if "created_epoch" in customers.columns else F.col("updated_epoch")
    return customers.where(
        (F.col("channel") == "web") & ~F.col("channel_user_id").startswith("phone:") & blank
        & ~F.coalesce("pdpa_consent", F.lit(False)) & (idle < as_of - days * DAY_SECONDS))


def without_rows_in(candidates: DataFrame, dependants: list[DataFrame]) -> DataFrame:
    """Candidates with no row in any dependent table. Their ids are put together first, so it is one anti-join."""
    ids = [d.select("customer_id").distinct() for d in dependants]
    return candidates.join(reduce(DataFrame.unionByName, ids), "customer_id", "left_anti")


def purgeable_customers(customers: DataFrame, dependants: list[DataFrame], as_of: int, days: int) -> DataFrame:
    return without_rows_in(session_only_customers(customers, as_of, days), dependants).select("customer_id")


def purge(chat: DataFrame, customers: DataFrame, session_state: DataFrame, dependants: list[DataFrame], as_of: int,
          chat_days: int = 90, customer_days: int = 30) -> dict[str, DataFrame]:
    """What survives of chat, customers and session_state, and how many rows of the first two go (``counts``)."""
    old = F.col("created_epoch") < as_of - chat_days * DAY_SECONDS
    gone = purgeable_customers(customers, dependants, as_of, customer_days)
    counts = chat.where(old).agg(F.count("*").alias("n")).select(F.lit("chat_messages_deleted").alias("what"), "n").unionByName(
        gone.agg(F.count("*").alias("n")).select(F.lit("session_customers_deleted").alias("what"), "n"))
    return {
        "chat": chat.where(~old),
        "customers": customers.join(gone, "customer_id", "left_anti"),
        "session_state": session_state.join(gone, "customer_id", "left_anti"),
        "counts": counts,
    }
