"""Checks on assistant replies: booking codes, leaks, unbacked confirmations, repair, and transcript scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seatwise.functions import lexicon
from seatwise.functions.scalars import by_language, clip, local_date, nullif_blank
from seatwise.operators.windows import trailing_rows, with_rolling_latest

CODE_PREFIX, CODE_MIN, CODE_MAX = "RSV-", 4, 10

#: A question: what runs up to a question mark, with at most one opening mark in it. It starts a sentence and never gives
#: back what it took, so a text is read once however long its sentences are.
QUESTION = r"(?<![^.?!¿])[^.?!¿]*+(?:¿[^.?!¿]*+)?\?"


# ----------------------------------------------------------------------------------------------------------- text rules

def extract_codes(text: Column, prefix: str = CODE_PREFIX, low: int = CODE_MIN, high: int = CODE_MAX) -> Column:
    """Distinct booking codes of a text, upper case, in order of appearance."""
    pattern = rf"(?i)\b{prefix}[A-Z0-9]{{{low},{high}}}\b"
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda c: F.upper(c)))


def detect_language(text: Column) -> Column:
    words = text.rlike(f"(?iu){lexicon.SPANISH_MARKS}") | text.rlike(f"(?iu){lexicon.SPANISH_WORDS}")
    return F.when(text.rlike(lexicon.THAI_BLOCK), "th").when(words, "es").otherwise("en")


def leak_patterns(internal_id: str | None) -> list[str]:
    names = [rf"\b({'|'.join(lexicon.TOOL_NAMES)})\b", rf"\b({'|'.join(lexicon.INTERNAL_NAMES)})\b"]
    return names + ([internal_id] if internal_id else []) + [lexicon.RAW_JSON]


def _any_match(text: Column, patterns: list[str]) -> Column:
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | text.rlike(f"(?i){pattern}")
    return hit


def leak_flag(text: Column, internal_id: str | None = "VENUE-INTERNAL-ID") -> Column:
    """Tool or internal status names, the internal identifier, or raw JSON."""
    return _any_match(text, leak_patterns(internal_id))


def confirmation_claim_flag(text: Column) -> Column:
    hit = F.lit(False)
    for pattern in lexicon.CLAIM_PATTERNS:
        hit = hit | text.rlike(f"(?iu){pattern}")
    return hit


def question_intent(text: Column) -> Column:
    """What the questions of a text ask for; without a question mark the whole text is looked at."""
    lowered = F.lower(text)
    questions = F.array_join(F.regexp_extract_all(lowered, F.lit(QUESTION), 0), " ")
    asked = F.when(questions != "", questions).otherwise(lowered)
    chain = F
    for name, pattern in lexicon.QUESTION_INTENTS.items():
        chain = chain.when(asked.rlike(pattern), F.lit(name))
    return chain.otherwise("other")


# ------------------------------------------------------------------------------------------------------ conversation rows

def pair_replies(chat: DataFrame) -> DataFrame:
    """Each assistant message with the guest message one turn before it (empty when there is none)."""
    guest = chat.where(F.col("type") == "human").select(
        "session_id", (F.col("turn") + 1).alias("turn"), F.col("content").alias("guest_text"))
    return chat.where(F.col("type") == "ai").select("id", "session_id", "turn", "created_epoch", F.col("content").alias("output")).join(
        guest, ["session_id", "turn"], "left").withColumn("guest_text", F.coalesce("guest_text", F.lit("")))


def with_codes(replies: DataFrame, **code_shape) -> DataFrame:
    """``all_codes`` of the reply, and ``check_codes``: those the guest did not write in this message."""
    typed = F.upper("guest_text")
    return replies.withColumn("all_codes", extract_codes(F.col("output"), **code_shape)).withColumn(
        "check_codes", F.filter("all_codes", lambda c: ~F.contains(typed, c)))


def typed_codes(chat: DataFrame, prefix: str = CODE_PREFIX, low: int = CODE_MIN, high: int = CODE_MAX) -> DataFrame:
    """Per session: every code a guest message contains, as a substring, with the first turn it appears in.

    A message contains a code exactly when, at some place of the prefix, the letters and digits that follow start with the
    code's tail. So each place yields its few possible codes, and codes can be looked up by equality instead of ``LIKE``.
    """
    tails = F.regexp_extract_all(F.upper("content"), F.lit(rf"(?={prefix}([A-Z0-9]{{{low},{high}}}))"), 1)
    lengths = F.sequence(F.lit(low), F.length("tail"))
    return (
        chat.where(F.col("type") == "human").select("session_id", "turn", F.explode(tails).alias("tail"))
        .select("session_id", "turn", F.explode(F.transform(
            lengths, lambda n: F.concat(F.lit(prefix), F.substring(F.col("tail"), F.lit(1), n)))).alias("code"))
        .groupBy("session_id", "code").agg(F.min("turn").alias("first_turn"))
    )


def codes_not_typed(coded: DataFrame, chat: DataFrame) -> DataFrame:
    """(id, code) pairs to check that the guest did not write in an earlier turn of the same session."""
    asked = coded.select("id", "session_id", "turn", F.explode("check_codes").alias("code"))
    typed = typed_codes(chat)
    early = F.coalesce(F.col("first_turn") < F.col("turn"), F.lit(False))
    return asked.join(typed, ["session_id", "code"], "left").where(~early).select("id", "code")


def verify_codes(coded: DataFrame, reservations: DataFrame, chat: DataFrame, as_of: int, tz: str = "Asia/Bangkok") -> DataFrame:
    """``coded`` replies (with customer_id) plus unknown_codes, known_codes and has_active_booking."""
    booked = reservations.select(F.upper("confirmation_code").alias("code"), "status").groupBy("code").agg(
        F.max(F.col("status") == "confirmed").alias("confirmed"))
    asked = coded.select("id", "session_id", "turn", "check_codes", F.explode("all_codes").alias("code"))
    known = F.coalesce("confirmed", F.lit(False))
    early = F.coalesce(F.col("first_turn") < F.col("turn"), F.lit(False))
    unknown = F.array_contains("check_codes", F.col("code")) & F.col("confirmed").isNull() & ~early
    per_reply = asked.join(booked, "code", "left").join(typed_codes(chat), ["session_id", "code"], "left").groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(unknown, F.col("code")))).alias("unknown_codes"),
        F.array_sort(F.collect_list(F.when(known, F.col("code")))).alias("known_codes"))
    today = local_date(as_of, F.lit(tz))
    active = reservations.where((F.col("status") == "confirmed") & (F.col("reservation_date") >= today)).select(
        "customer_id", F.lit(True).alias("has_active_booking")).distinct()
    none = F.array().cast("array<string>")
    return (
        coded.join(per_reply, "id", "left").join(active, "customer_id", "left")
        .withColumn("unknown_codes", F.coalesce("unknown_codes", none))
        .withColumn("known_codes", F.coalesce("known_codes", none))
        .withColumn("has_active_booking", F.coalesce("has_active_booking", F.lit(False)))
    )


def judge_reply(verified: DataFrame, contact: str, lookup_ok: Column | None = None, internal_id: str | None = "VENUE-INTERNAL-ID") -> DataFrame:
    """The reply to send: first of leak, unknown_code, unbacked_confirmation blocks it and a careful text takes its place.

    Otherwise internal labels become plain words. When the lookup failed only the leak rule applies.
    """
    looked_up = F.lit(True) if lookup_ok is None else lookup_ok
    output = F.col("output")
    unbacked = confirmation_claim_flag(output) & (F.size("known_codes") == 0) & ~F.col("has_active_booking")
    reason = (
        F.when(leak_flag(output, internal_id), "leak")
        .when(looked_up & (F.size("unknown_codes") > 0), "unknown_code")
        .when(looked_up & unbacked, "unbacked_confirmation"))
    safe = F
    for name, texts in lexicon.SAFE_REPLIES.items():
        safe = safe.when(F.col("block_reason") == name, by_language(F.col("lang"), {
            k: v.replace("{contact}", contact) for k, v in texts.items()}))
    relabeled = output
    for pattern, words in lexicon.INTERNAL_LABELS.items():
        relabeled = by_language(F.col("lang"), {k: F.regexp_replace(relabeled, pattern, w) for k, w in words.items()})
    blocked = F.col("block_reason").isNotNull()
    return (
        verified.withColumn("lang", detect_language(F.col("guest_text"))).withColumn("block_reason", reason)
        .withColumn("relabeled", relabeled)
        .withColumn("output_check", F.when(blocked, "blocked").when(~looked_up, "lookup_failed")
                    .when(F.col("relabeled") == output, "ok").otherwise("relabeled"))
        .withColumn("blocked_output", F.when(blocked, output))
        .withColumn("output", F.when(blocked, safe).otherwise(F.col("relabeled")))
        .drop("relabeled")
    )


# ------------------------------------------------------------------------------------------------------------- memory

def last_ai_message(asks: DataFrame, chat: DataFrame, seconds: int = 600, epoch: str = "epoch") -> DataFrame:
    """``asks`` (session_id, epoch) plus the newest assistant message of the session from the last ten minutes."""
    spoken = chat.where(F.col("type") == "ai")
    return with_rolling_latest(asks, spoken, ["session_id"], seconds, "id", "target_id", epoch, "created_epoch")


def repair_memory(chat: DataFrame, blocked: DataFrame, epoch: str = "epoch") -> tuple[DataFrame, DataFrame]:
    """Chat with the blocked reply's text replaced, and one report row per blocked reply (memory_fixed 0 or 1)."""
    targeted = last_ai_message(blocked, chat, epoch=epoch)
    report = targeted.withColumn("memory_fixed", F.col("target_id").isNotNull().cast("int"))
    patch = targeted.where(F.col("target_id").isNotNull()).groupBy(F.col("target_id").alias("id")).agg(
        F.max_by("output", F.struct(epoch, "id")).alias("_text"))
    return chat.join(patch, "id", "left").withColumn("content", F.coalesce("_text", "content")).drop("_text"), report


def trailing_messages(chat: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` messages of each session."""
    return trailing_rows(chat, ["session_id"], [F.col("id").desc()], n)


def cases_from_blocked(judged: DataFrame, guests: DataFrame) -> DataFrame:
    """A staff case for every reply blocked as an unbacked confirmation."""
    people = guests.select("customer_id", "phone", "email", F.concat_ws(" ", "name", "surname").alias("guest_name"), "language", "channel")
    contact = F.coalesce(nullif_blank(F.col("phone")), nullif_blank(F.col("email")),
                         F.when((F.col("channel") == "telegram") & F.col("username").isNotNull(), F.concat(F.lit("Telegram @"), "username")),
                         F.concat(F.lit("No contact yet: check the conversation "), F.col("session_id").cast("string")))
    if "username" not in judged.columns:
        judged = judged.withColumn("username", F.lit(None).cast("string"))
    summary = F.concat(
        F.lit("Automatic check: the guest was told the booking was confirmed, but has no confirmed booking. The reply was blocked. Blocked reply: "),
        clip(F.col("blocked_output"), 600))
    return judged.where(F.col("block_reason") == "unbacked_confirmation").join(people, "customer_id", "left").select(
        F.col("id").alias("case_id"), "channel", F.col("session_id").alias("session_key"), F.lit("tool_failure").alias("reason"),
        F.lit("normal").alias("urgency"), summary.alias("summary"), "guest_name", contact.alias("guest_contact"),
        F.lit("").alias("confirmation_code"), F.coalesce("language", F.lit("")).alias("language"), F.col("created_epoch").alias("epoch"))


# ------------------------------------------------------------------------------------------------------------ scoring

def score_transcripts(turns: DataFrame, bookings: DataFrame, rules: DataFrame) -> DataFrame:
    """Pass or fail per (run_id, scenario), with what was seen.

    ``turns``: run_id, scenario, who, text. ``bookings``: run_id, status, reservation_date, reservation_min, people,
    special_requests, logged_changes. ``rules`` (one row per scenario, nulls ask nothing): must_match with min_hits,
    must_not_match, expect_bookings, expect_date, expect_min, expect_people, expect_status, note_match, expect_logged.
    Patterns are looked for turn by turn over what the agent said, hits are summed.
    """
    said = turns.where(F.col("who") == "agent").join(rules.select("scenario", "must_match", "must_not_match"), "scenario")
    lowered = F.lower("text")
    talk = said.groupBy("run_id", "scenario").agg(
        F.sum(F.coalesce(F.regexp_count(lowered, F.col("must_match")), F.lit(0))).alias("hits"),
        F.max(F.coalesce(F.regexp_like(lowered, F.col("must_not_match")), F.lit(False))).alias("said_forbidden"))
    runs = turns.select("run_id", "scenario").distinct()
    expected = runs.join(rules, "scenario")
    fits = F.lit(True)
    for rule, seen in (("expect_date", "reservation_date"), ("expect_min", "reservation_min"), ("expect_people", "people"), ("expect_status", "status")):
        fits = fits & F.coalesce(F.col(rule) == F.col(seen), F.col(rule).isNull())
    fits = fits & (F.col("note_match").isNull() | F.coalesce(F.regexp_like(F.lower("special_requests"), F.col("note_match")), F.lit(False)))
    fits = fits & (F.col("expect_logged").isNull() | (F.coalesce("logged_changes", F.lit(0)) >= F.col("expect_logged")))
    rows = expected.join(bookings, "run_id", "left").groupBy("run_id", "scenario").agg(
        F.count_if(F.col("status").isNotNull()).alias("bookings"),
        F.count_if(F.col("status").isNotNull() & fits).alias("fitting"))
    judged = expected.join(talk, ["run_id", "scenario"], "left").join(rows, ["run_id", "scenario"])
    hits = F.coalesce("hits", F.lit(0))
    words_ok = F.col("must_match").isNull() | (hits >= F.coalesce("min_hits", F.lit(1)))
    asks_row = F.lit(False)
    for rule in ("expect_date", "expect_min", "expect_people", "expect_status", "note_match", "expect_logged"):
        asks_row = asks_row | F.col(rule).isNotNull()
    rows_ok = (F.col("expect_bookings").isNull() | (F.col("bookings") == F.col("expect_bookings"))) & (~asks_row | (F.col("fitting") > 0))
    clean = ~F.coalesce("said_forbidden", F.lit(False))
    return judged.select(
        "run_id", "scenario", (words_ok & rows_ok & clean).alias("ok"), hits.cast("long").alias("hits"),
        (~clean).alias("said_forbidden"), "bookings", "fitting",
        F.concat(F.lit("bookings="), F.col("bookings").cast("string"), F.lit("; hits="), hits.cast("string")).alias("detail"))
