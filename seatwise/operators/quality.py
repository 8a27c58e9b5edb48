"""Row rules, uniqueness, code backfill and guarded deletion."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from seatwise.functions import lexicon


def subset_rule(column: str, vocabulary: list[str], non_empty: bool = False) -> Column:
    known = F.size(F.array_except(column, F.array(*[F.lit(v) for v in vocabulary]))) == 0
    return known & (F.size(column) > 0) if non_empty else known


def menu_rules(id_digits: int = 3) -> dict[str, Column]:
    """The rules an item table must satisfy; a rule that is null (nothing to check) passes."""
    return {
        "id": F.col("id").rlike(f"^[FB][0-9]{{{id_digits}}}$"),
        "kind": F.col("kind").isin("food", "drink"),
        "price": F.col("price_thb") >= 0,
        "service": subset_rule("service", lexicon.SERVICES, non_empty=True),
        "allergens": subset_rule("allergens", lexicon.ALLERGENS),
        "diet": subset_rule("diet", lexicon.DIETS),
        "spicy": F.col("spicy").between(0, 3),
        "contains": subset_rule("contains", lexicon.CONTENTS),
        "dates": F.col("available_from") <= F.col("available_to"),
    }


def case_rules() -> dict[str, Column]:
    return {"channel": F.col("channel").isin(*lexicon.CHANNELS), "reason": F.col("reason").isin(*lexicon.CASE_REASONS),
            "urgency": F.col("urgency").isin("urgent", "normal"), "status": F.col("status").isin(*lexicon.CASE_STATUSES),
            "guest_contact": F.col("guest_contact").isNotNull()}


def special_date_rules() -> dict[str, Column]:
    return {"kind": F.col("kind").isin(*lexicon.SPECIAL_KINDS), "booking_policy": F.col("booking_policy").isin(*lexicon.BOOKING_POLICIES),
            "title": F.col("title").isNotNull()}


def log_rules() -> dict[str, Column]:
    return {"action": F.col("action").isin(*lexicon.LOG_ACTIONS), "reservation_id": F.col("reservation_id").isNotNull()}


def checked_rows(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``df`` plus the names of the rules each row breaks. As in a table constraint, an unknown outcome passes."""
    broken = [F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("reasons", F.array_compact(F.array(*broken)))


def validate_rows(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with their reasons."""
    checked = checked_rows(df, rules)
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; empty when they are unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    example = duplicates(df, keys).first()
    if example is not None:
        raise ValueError(f"{keys} are not unique, e.g. {example}")


def backfill_codes(reservations: DataFrame, prefix: str = "RSV-") -> DataFrame:
    """A code where none is stored: the prefix and ten upper-case hex digits drawn from the id (the same on every run)."""
    made = F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(F.col("reservation_id").cast("string"), 256), 1, 10)))
    missing = F.col("confirmation_code").isNull() | (F.trim("confirmation_code") == "")
    return reservations.withColumn("confirmation_code", F.when(missing, made).otherwise(F.col("confirmation_code")))


def targeted_customers(reservations: DataFrame, ids: DataFrame) -> DataFrame:
    """Customers of the bookings to delete (reservation_id with its confirmation_code), and what else they own."""
    mine = reservations.join(ids, ["reservation_id", "confirmation_code"], "left_semi").select("customer_id").distinct()
    listed = ids.select("reservation_id", F.lit(True).alias("_listed")).distinct()
    return (
        reservations.join(mine, "customer_id", "left_semi").join(listed, "reservation_id", "left")
        .groupBy("customer_id").agg(F.count_if(F.col("_listed")).alias("listed"), F.count_if(F.col("_listed").isNull()).alias("others"))
    )


def guarded_delete(tables: Mapping[str, DataFrame], ids: DataFrame, expected_customers: int) -> dict[str, DataFrame]:
    """Delete the listed bookings and their customers, or nothing.

    ``tables`` holds change_log, reservations, customers and perhaps consents; ``ids`` the (reservation_id, confirmation_code)
    pairs. Raises unless every pair is a booking, exactly ``expected_customers`` customers are touched and none owns another booking.
    """
    pairs = ids.select("reservation_id", "confirmation_code").distinct()
    unknown = pairs.join(tables["reservations"], ["reservation_id", "confirmation_code"], "left_anti")
    if not unknown.isEmpty():
        raise ValueError("a listed booking has another code or does not exist, nothing deleted")
    owners = targeted_customers(tables["reservations"], ids)
    seen = owners.agg(F.count("*").alias("customers"), F.sum("others").alias("others")).first()
    if seen["customers"] != expected_customers or (seen["others"] or 0) > 0:
        raise ValueError(f"targets are not the expected ones, nothing deleted: {seen}")
    out = dict(tables)
    for name in ("change_log", "reservations"):
        out[name] = tables[name].join(ids.select("reservation_id"), "reservation_id", "left_anti")
    for name in [n for n in ("consents", "customers") if n in tables]:
        out[name] = tables[name].join(owners.select("customer_id"), "customer_id", "left_anti")
    return out


def delete_by_tag(tables: Mapping[str, DataFrame], tag: str, by_prefix: bool = False) -> dict[str, DataFrame]:
    """Remove everything tagged: bookings of a channel with their log rows, and the customers of that channel.

    ``by_prefix`` takes the tag as the beginning of ``channel_user_id`` instead, as for a range of test phones.
    """
    customers, reservations = tables["customers"], tables["reservations"]
    if by_prefix:
        doomed_customers = customers.where(F.col("channel_user_id").startswith(tag)).select("customer_id")
        doomed = reservations.join(doomed_customers, "customer_id", "left_semi").select("reservation_id")
    else:
        doomed_customers = customers.where(F.col("channel") == tag).select("customer_id")
        doomed = reservations.where(F.col("channel") == tag).select("reservation_id")
    out = dict(tables)
    out["change_log"] = tables["change_log"].join(doomed, "reservation_id", "left_anti")
    out["reservations"] = reservations.join(doomed, "reservation_id", "left_anti")
    out["customers"] = customers.join(doomed_customers, "customer_id", "left_anti")
    if "consents" in tables:
        out["consents"] = tables["consents"].join(doomed_customers, "customer_id", "left_anti")
    return out


def remaining(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table, as one report."""
    counts = [df.agg(F.count("*").alias("rows_left")).select(F.lit(name).alias("table_name"), "rows_left") for name, df in tables.items()]
    report = counts[0]
    for other in counts[1:]:
        report = report.unionByName(other)
    return report
