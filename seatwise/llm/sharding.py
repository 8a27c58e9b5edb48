"""Sharding by balanced label propagation over links between documents of equal texts.

Copies of a text are linked with each other. They have one size, so a group's state is how many of its copies each shard holds: a group
of any size is at most ``shards`` rows. Labels start as a hash. In every round a join of the state with itself offers the copies in
a shard the shard where most of their group is, among those with room; offers to a shard are taken up in hashed order until its
quota is used. Between shards with equally many, one with room comes first, then a hash decides. Groups that are still split after some
rounds are dealt out whole if they are small beside a shard; large ones go on until a round moves nothing. Groups larger than a shard
stay split, in as few shards as hold them.

Documents without copies cut no link wherever they are; they even out the sizes, as do the groups dealt out whole. From the largest sizes to the smallest they are dealt
out, in hashed order, in proportion to the room that the shards have left, so the error of one step is mended by the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatwise.llm.common import running, written

GROUP = ["key", "text_crc32", "size"]
#: A split group is dealt out whole if it is at most one in WHOLE of a shard's share.
WHOLE = 32
#: Documents without copies and such groups are dealt out by size: at least this many bytes first, then the next.
STEPS = (1 << 24, 1 << 22, 1 << 20, 1 << 18, 1 << 16, 1 << 14, 1 << 12, 1 << 10, 1 << 8, 1 << 6, 0)


def loads_of(df: DataFrame, value: Column, shards: int) -> list[int]:
    found = {r["shard"]: r["b"] for r in df.groupBy("shard").agg(F.sum(value).alias("b")).collect()}  # one row per shard
    return [found.get(s) or 0 for s in range(shards)]


def pick(values: list, at: Column) -> Column:
    return F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), at)


def propagate(state: DataFrame, shards: int, capacity: int, rounds: int | None, besides: list[int]) -> DataFrame:
    """Moves copies towards their group's shard, for some rounds or (None) until nothing moves. ``state``: GROUP, shard, n; ``besides`` is
    what else the shards hold. A copy's target is the first in one order of those with room, which gives none away itself, so every
    round that moves any raises the sum of n * n, and the rounds end."""
    while rounds is None or rounds > 0:
        rounds = rounds if rounds is None else rounds - 1
        load = loads_of(state, F.col("size") * F.col("n"), shards)
        room = [max(0, capacity - a - b) for a, b in zip(load, besides, strict=True)]

        def place(side: str) -> Column:
            shard = F.col(f"{side}.shard")
            return F.struct(F.col(f"{side}.n").alias("m"), (pick(room, shard) >= F.col(f"{side}.size")).alias("fits"),
                            F.xxhash64(F.col(f"{side}.key"), shard).alias("drawn"), (-shard).alias("less"))

        here, there = state.alias("h"), state.alias("t")
        same = [F.col(f"h.{c}") == F.col(f"t.{c}") for c in GROUP]
        better = place("t") > place("h")
        offers = (here.join(there, same).where(better & (pick(room, F.col("t.shard")) >= F.col("t.size")))
                  .groupBy(*[F.col(f"h.{c}").alias(c) for c in GROUP], F.col("h.shard").alias("shard"), F.col("h.n").alias("n"))
                  .agg(F.max(place("t")).alias("best")))
        offers = offers.select(*GROUP, "shard", "n", (-F.col("best.less")).alias("target"), (F.col("size") * F.col("n")).alias("bytes"))
        offers = running(offers, ["target"], {"before": "bytes"}, [*GROUP, "shard"])
        left = F.greatest(pick(room, F.col("target")) - F.col("before"), F.lit(0))
        moves = offers.withColumn("moved", F.least("n", F.floor(left / F.col("size")).cast("long"))).where("moved > 0")
        moves = written(moves.select(*GROUP, "shard", "target", "moved"), "moves")
        if moves.isEmpty():
            break
        state = written(state.unionByName(moves.select(*GROUP, "shard", (-F.col("moved")).alias("n")))
                        .unionByName(moves.select(*GROUP, F.col("target").alias("shard"), F.col("moved").alias("n")))
                        .groupBy(*GROUP, "shard").agg(F.sum("n").alias("n")).where("n > 0"), "state")
    return state


def filled(loads: list[int], amount: int) -> list[float]:
    """How much of ``amount`` each shard gets so that the loads come out as even as they can."""
    level, raised = 0.0, sorted(loads)
    for count in range(1, len(raised) + 1):
        level = (amount + sum(raised[:count])) / count
        if count == len(raised) or level <= raised[count]:
            break
    return [max(0.0, level - load) for load in loads]


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 16, rounds: int = 6) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in its shard) and grown_shard (null) of every row.

    Size is the text's UTF-8 bytes plus 1; a null text has none and is a text of its own value, equal to the empty one. Repeated rows
    are copies like any others and come back as often as given. A null doc_id is placed like any other. One very long text may be
    larger than a shard's share; its shard then gets nothing else that can go elsewhere. An empty table gives no rows. Other
    columns are ignored.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = written(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(value) + 1).cast("long").alias("size"),
                               F.crc32(value).alias("text_crc32"), F.xxhash64(value).alias("key")), "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    marked = written(rows.join(groups, GROUP, "left"), "marked")
    linked, alone = marked.where("copies is not null"), marked.where("copies is null")

    first = F.pmod(F.xxhash64("doc_id", "key"), F.lit(shards)).cast("int").alias("shard")
    state = written(linked.select(*GROUP, first).groupBy(*GROUP, "shard").agg(F.count(F.lit(1)).alias("n")), "state")
    capacity = total // shards
    state = propagate(state, shards, capacity, rounds, [0] * shards)
    split = written(state.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("copies")).where("parts > 1").drop("parts")
                    .withColumn("bytes", F.col("size") * F.col("copies")), "split")
    small, large = split.where(F.col("bytes") * WHOLE <= capacity), split.where(F.col("bytes") * WHOLE > capacity)
    settled = written(state.join(split, GROUP, "left_anti"), "settled")
    moving = written(state.join(large, GROUP, "left_semi"), "state")
    state = settled.unionByName(propagate(moving, shards, capacity, None, loads_of(settled, F.col("size") * F.col("n"), shards)))
    loads = loads_of(state, F.col("size") * F.col("n"), shards)

    step = F.expr("CASE " + " ".join(f"WHEN bytes >= {least} THEN {i}" for i, least in enumerate(STEPS)) + " END")
    units = alone.withColumn("bytes", F.col("size")).unionByName(small, allowMissingColumns=True)  # groups have copies and no doc_id
    dealt = written(running(units.withColumn("step", step), ["step"], {"before": "bytes"}, ["key", "doc_id"]), "dealt")
    amounts = {r["step"]: r["b"] for r in dealt.groupBy("step").agg(F.sum("bytes").alias("b")).collect()}  # one row per step
    placed = None
    for i in sorted(amounts):
        ends, end = [], 0.0
        for share in filled(loads, amounts[i])[:-1]:
            end += share
            ends.append(end)
        middle = F.col("before") + F.col("bytes") / 2
        shard = sum([(middle >= F.lit(e)).cast("int") for e in ends], F.lit(0)).cast("int").alias("shard")
        own = dealt.where(F.col("step") == i)
        loads = [a + b for a, b in zip(loads, loads_of(own.select("bytes", shard), F.col("bytes"), shards), strict=True)]
        state = state.unionByName(own.where("copies is not null").select(*GROUP, shard, F.col("copies").alias("n")))
        singles = own.where("copies is null").select("doc_id", "size", "text_crc32", shard)
        placed = singles if placed is None else placed.unionByName(singles)

    in_order = Window.partitionBy(*GROUP).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spans = (state.withColumn("from", F.coalesce(F.sum("n").over(in_order), F.lit(0))).groupBy(*GROUP)
             .agg(F.array_sort(F.collect_list(F.struct("from", "shard"))).alias("spans")))  # at most one entry per shard
    one = F.lit(1).cast("long")
    ranked = running(linked.withColumn("one", one), GROUP, {"rank": "one"}, ["doc_id"])
    ranked = ranked.join(spans, GROUP)
    at = F.array_max(F.filter("spans", lambda s: s["from"] <= F.col("rank")))
    copies = ranked.select("doc_id", "size", "text_crc32", at["shard"].cast("int").alias("shard"))
    placed = copies if placed is None else copies.unionByName(placed)
    slotted = running(placed.withColumn("one", one), ["shard"], {"slot": "one"}, ["doc_id", "text_crc32", "size"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
