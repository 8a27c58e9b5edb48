"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Slots of ``block`` words are numbered from 0. Slot k's point is frac(k * golden ratio), in whole numbers of 31 bits so that it is exact; the
cumulative target shares turn the point into a source, so every stretch of the schedule holds each source in nearly its share. A
source's slots are ranked; slot r of a source reads its r-th block: the source's documents in shuffled order, cut into equal blocks
of words, begun anew when they end. A document's words are taken as often as its blocks are read; the last block stops at the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatwise.llm.common import running, written

#: The golden ratio's fraction in units of 2 ** -31 (an odd number, so 2 ** 31 slots pass before a point comes again).
GOLDEN, PERIOD = 1327217885, 1 << 31
#: Cells of [0, 1) by which points and sources meet in an equi-join.
CELLS = 1024
MOST_PASSES = 3
WEIGHTS = (5, 2, 1)


def source_key(source: Column) -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def word_count(text: Column) -> Column:
    """The words of a text (null: 0). Each becomes one letter, with the blanks behind it; counting matches would hold an array of all of them."""
    letters = F.regexp_replace(text, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "w")
    return F.coalesce(F.length(F.ltrim(letters, F.lit(" \t\n\x0b\x0c\r"))), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> and its target: 5, 2, 1 in turn by code point (null last) of all words, at most three times the size.

    What the limit cuts is shared again by weight until nobody is above: every source gets min(limit, weight * level) with one level,
    found from running sums over the sources ordered by limit / weight. One row per source.
    """
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.row_number().over(ordered) - 1) % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.alias("weight"))
    rows = rows.withColumn("limit", (F.col("source_size") * MOST_PASSES).cast("double"))
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*", F.sum("source_size").over(everything).cast("double").alias("total"), F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("limits"), F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("gone"))
    level = (F.col("total") - F.col("limits")) / (F.col("weights") - F.col("gone"))
    rows = rows.withColumn("level", F.when(level * F.col("weight") < F.col("limit"), level))
    return rows.select("source", "source_size", F.least("limit", F.col("weight") * F.coalesce(F.max("level").over(everything), F.lit(float("inf"))))
                       .alias("target"))


def schedule(goals: DataFrame, block: int, total: int) -> DataFrame:
    """source, rank and slot of every slot that is used: a source's first ceil(target / block)."""
    spark = goals.sparkSession
    slots = -(-total // block)
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    shares = goals.where("target > 0").withColumn("share", F.try_divide("target", F.sum("target").over(Window.partitionBy())))
    high = F.sum("share").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    spans = shares.select("source", "target", F.when(high > 1 - 1e-9, F.lit(1.0)).otherwise(high).alias("high"))
    spans = spans.withColumn("low", F.coalesce(F.lag("high").over(ordered), F.lit(0.0)))
    cells = spans.select("*", F.explode(F.sequence(F.floor(F.col("low") * CELLS).cast("int"),
                                                   F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)).cast("int"))).alias("cell"))
    point = ((F.col("id") % PERIOD) * GOLDEN % PERIOD) / F.lit(float(PERIOD))
    # A quarter more slots than the targets need, so that every source's rank reaches its target whatever the discrepancy.
    drawn = spark.range(slots + slots // 4 + 64).select(F.col("id").alias("slot"), point.alias("point"))
    drawn = drawn.withColumn("cell", F.floor(F.col("point") * CELLS).cast("int"))
    met = drawn.join(cells, "cell").where("point >= low and point < high").select(
        source_key(F.col("source")).alias("key"), "target", "slot", F.lit(1).cast("long").alias("one"))
    ranked = running(met, ["key"], {"rank": "one"}, ["slot"], bucket=F.floor(F.col("slot") / 16384))
    # A share so small that too few points fall on it gets the slots it lacks at the end of the schedule.
    had = met.groupBy("key").agg(F.count(F.lit(1)).alias("had"))
    due = goals.where("target > 0").select(source_key(F.col("source")).alias("key"), "target", F.ceil(F.col("target") / block).alias("due"))
    late = due.join(had, "key", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("due > had").select(
        "key", F.explode(F.sequence("had", F.col("due") - 1)).alias("rank"), "target")
    late = late.select("key", "rank", (F.col("rank") + F.lit(slots + slots // 4 + 64)).alias("slot"), "target")
    return ranked.where(F.col("rank") * block < F.col("target")).select("key", "rank", "slot", "target").unionByName(late)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = 256) -> DataFrame:
    """doc_id, size, source_size, target, taken and first_slot (where the schedule meets it first) for every row of ``docs``.

    Null and blank texts have size 0 and nothing is taken. A null source is a source of its own, the last. Repeated rows are documents
    of their own; a null doc_id is an id like any other. With no words at all every target is 0; an empty table gives no rows.
    The same rows give the same result in every run, however they are partitioned. Other columns are ignored.
    """
    rows = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = written(targets(sizes), "targets")
    total = goals.agg(F.sum("source_size")).first()[0] or 0
    slots = schedule(goals, block, total)

    facts = goals.select(source_key(F.col("source")).alias("key"), "source_size", "target")
    rows = rows.withColumn("key", source_key(F.col("source")))
    dealt = rows.where("size > 0").select("key", "doc_id", "size", F.md5(F.concat_ws(":", "doc_id", "size")).alias("order"))
    placed = written(running(dealt, ["key"], {"start": "size"}, ["order", "doc_id", "size"]).join(facts, "key").drop("order"), "placed")
    # Every pass over the source is a stretch of its own; only those that begin before the target are read.
    read = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(MOST_PASSES - 1))).alias("pass"))
    read = read.withColumn("from", F.col("start") + F.col("pass") * F.col("source_size")).where("from < target")
    read = read.select("*", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("from") + F.col("size") - 1) / block))).alias("rank"))
    stop = F.least(F.col("from") + F.col("size"), (F.col("rank") + 1) * block, F.floor("target").cast("long"))
    words = F.greatest(stop - F.greatest(F.col("from"), F.col("rank") * block), F.lit(0))
    met = read.select("key", "start", "rank", words.alias("words")).join(slots.select("key", "rank", "slot"), ["key", "rank"])
    taken = met.groupBy("key", "start").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    found = placed.join(taken, ["key", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    blank = (rows.where("size = 0").select("key", "doc_id", "size").join(facts, "key")
             .withColumns({"taken": F.lit(0).cast("long"), "first_slot": F.lit(None).cast("long")}))
    columns = ["doc_id", "size", "source_size", "target", "taken", "first_slot", "key"]
    return found.select(*columns).unionByName(blank.select(*columns))


def repeat(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: a document whose words are taken once and a part of them again comes twice, one that is not
    taken goes. Only the document at the end of a source's target is taken in part; it comes whole. Columns stay as they are."""
    mixed = mix(docs, doc_id, text, source).where("taken > 0").select(
        "key", F.col("doc_id").alias("id"), "size", F.ceil(F.col("taken") / F.col("size")).cast("int").alias("copies"), "first_slot")
    keys = [F.coalesce(F.col("id").cast("string"), F.lit("")), "key", "size"]
    marks = ["_id", "_key", "_size"]

    def numbered(df: DataFrame, order: list) -> DataFrame:
        return df.withColumn("_place", F.row_number().over(Window.partitionBy(*marks).orderBy(*order)))

    left = docs.withColumns({"_id": F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "_key": source_key(F.col(source)),
                             "_size": word_count(F.col(text))})
    right = mixed.select(*[k if isinstance(k, str) else k.alias("_id") for k in keys], "copies", "first_slot")
    right = right.toDF("_id", "_key", "_size", "copies", "first_slot")
    left = numbered(left, [F.xxhash64(F.col(text))])
    right = numbered(right, ["first_slot"])
    # Rows that share id, source and size are told apart by their place; as a difference, it leaves the join on the windows' own keys.
    met = left.alias("l").join(right.alias("r"), [F.col(f"l.{m}") == F.col(f"r.{m}") for m in marks] + [F.col("l._place") - F.col("r._place") == 0])
    return met.select(*[F.col(f"l.`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("r.copies"))).alias("_copy")).select(
        *[F.col(f"`{c}`") for c in docs.columns])
