"""Ranked lexical search by pipelined term partitioning.

1. Every item (a row of the queries) is in a bundle. Terms belong to owners by how many documents hold them, rare terms to the first
   owner. An owner keeps its terms' postings in blocks of documents: document, term and the integer contribution of its frequency.
2. A bundle visits the owners in turn, at every block of documents on its own (cogroup by bundle and block). It carries its items'
   accumulators, sparse triples of item, document and score; an owner adds its terms' weights times contributions.
3. After each owner the 20th best partial score of an item over all blocks is a bound that its answers must reach. What the owners still
   to come can add at most (each term's weight times the largest contribution it has in any document) decides exactly: accumulators
   that cannot reach the bound are dropped, and an item whose later terms together cannot reach it takes no new documents.
4. The last owner hands over each block's best; what is left is ranked over all blocks.

Everything is in 64-bit integers but the logarithm of a term's weight. Blocks hold 2,048 documents and bundles 256 items, so a group's
tables are bounded however frequent a term is, and answers do not depend on how rows fall into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seatwise.llm.byte_runs import byte_class, numbered, runs
from seatwise.llm.common import batches_of, written
from seatwise.llm.words import lowered, text_bytes, word_hashes

#: Bytes of terms: 0-9, A-Z, a-z and all of characters beyond ASCII.
TERM = byte_class(bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))
#: Marks that tell whether a term can be one of an item's; a fixed size, checked exactly by a join afterwards.
MARKS = 1 << 20
#: An owner holds terms that at most one of so many documents has; the last owner holds the others.
OWNERS = (64, 8)


def terms_of(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Term numbers of all texts of a batch one after another, the terms by number, and how many terms precede each text."""
    data, offsets = text_bytes(batch.column("text"))
    inside = TERM[data]
    starts, ends, firsts = runs(inside, offsets)
    numbers, terms = numbered(lowered(data), inside, starts, ends)
    return numbers, terms, firsts


def marks(terms: pa.Array) -> np.ndarray:
    """The mark of each term."""
    data, offsets = text_bytes(terms.cast(pa.string()))
    return (word_hashes(data, offsets[:-1], offsets[1:]) % np.uint64(MARKS)).astype(np.int64)


def counted_terms(rows: DataFrame, columns: str, only: np.ndarray | None = None) -> DataFrame:
    """Each row's distinct terms (those that ``only`` marks) with their frequencies, and n, the number of all its terms. ``columns`` are
    carried along as ``name type, ...``."""
    names = [c.split()[0] for c in columns.split(", ")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text", 4 << 20):
                numbers, terms, firsts = terms_of(batch)
                n = np.diff(firsts)
                row = np.repeat(np.arange(len(n)), n)
                if only is not None:
                    wanted = only[marks(terms)][numbers] if len(numbers) else np.zeros(0, bool)
                    numbers, row = numbers[wanted], row[wanted]
                held, tf = np.unique(row * max(1, len(terms)) + numbers, return_counts=True)
                ends = np.searchsorted(held, np.arange(len(n) + 1) * max(1, len(terms))).astype(np.int32)
                words = terms.cast(pa.string()).take(pa.array(held % max(1, len(terms))))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in names], pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), words),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(tf.astype(np.int64)))], [*names, "n", "terms", "tf"])

    return rows.mapInArrow(count, f"{columns}, n long, terms array<string>, tf array<long>")


def flat(counted: DataFrame, *columns: str) -> DataFrame:
    """A row with term and tf for each entry of the lists."""
    return counted.select(*columns, F.explode(F.arrays_zip("terms", "tf")).alias("t")).select(
        *columns, F.col("t.terms").alias("term"), F.col("t.tf").alias("tf"))


def marked(terms: DataFrame) -> np.ndarray:
    """For each mark whether a term has it; at most ``MARKS`` numbers come to the driver."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(marks(batch.column("term")))], ["mark"])

    held = np.zeros(MARKS, bool)
    held[[r.mark for r in terms.select("term").mapInArrow(mark, "mark long").distinct().collect()]] = True
    return held


def values(table: pa.Table, column: str, *fields: str) -> list[np.ndarray]:
    """The entries of the list in the table's only row: of the list, or of the fields of its structs."""
    entries = table.column(column)[0].values
    if not fields:
        return [entries.to_numpy(zero_copy_only=False)]
    return [entries.field(entries.type.get_field_index(f)).to_numpy(zero_copy_only=False) for f in fields]


def accumulated(left: pa.Table, right: pa.Table, owner: int, items: int) -> tuple[np.ndarray, np.ndarray]:
    """The bundle's scores in this block (items x documents) after this owner's postings, and which of them can still be answers."""
    scores = np.zeros((items, len(left.column("docs")[0])), np.int64)
    (slot,), (doc,), (score,) = values(left, "slot"), values(left, "doc"), values(left, "score")
    scores[slot, doc] = score
    known = scores > 0

    q_owner, q_slot, q_term, q_weight = values(left, "query", "owner", "slot", "term", "weight")
    mine = np.flatnonzero(q_owner == owner)
    mine = mine[np.argsort(q_term[mine], kind="stable")]
    q_slot, q_term, q_weight = q_slot[mine], q_term[mine], q_weight[mine]
    term, at, gain = (right.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("term", "at", "gain"))
    order = np.argsort(term, kind="stable")
    term, at, gain = term[order], at[order], gain[order]
    found, first, count = np.unique(term, return_index=True, return_counts=True)
    for t, a, b in zip(found, first, first + count, strict=True):
        x, y = np.searchsorted(q_term, t, "left"), np.searchsorted(q_term, t, "right")
        scores[np.ix_(q_slot[x:y], at[a:b])] += q_weight[x:y, None] * gain[None, a:b]

    b_owner, b_slot, bound = values(left, "bounds", "owner", "slot", "bound")
    still, later, least = np.zeros(items, np.int64), np.zeros(items, np.int64), np.zeros(items, np.int64)
    np.add.at(still, b_slot[b_owner >= owner], bound[b_owner >= owner])
    np.add.at(later, b_slot[b_owner > owner], bound[b_owner > owner])
    f_slot, f_least = values(left, "floors", "slot", "least")
    least[f_slot] = f_least
    taken = (scores > 0) & (known | (still >= least)[:, None]) & (scores + later[:, None] >= least[:, None])
    return scores, taken


def visit(state: DataFrame, postings: DataFrame, owner: int, items: int, most: int) -> DataFrame:
    """The bundles' state after one owner: the accumulators of every block, and the block's ``most`` best scores of each item."""

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        scores, taken = accumulated(left, right, owner, items)
        slot, doc = np.nonzero(taken)
        score = scores[slot, doc]
        order = np.lexsort((-score, slot))
        of = slot[order]
        best = order[np.arange(len(of)) - np.searchsorted(of, of) < most]
        lists = [pa.array([x], pa.list_(pa.int32())) for x in (slot, doc)] + [pa.array([score], pa.list_(pa.int64()))]
        tops = pa.StructArray.from_arrays([pa.array(slot[best], pa.int32()), pa.array(score[best], pa.int64())], ["slot", "score"])
        return pa.table([left.column("bundle"), left.column("block"), left.column("docs"), *lists,
                         pa.ListArray.from_arrays(pa.array([0, len(best)], pa.int32()), tops)], ["bundle", "block", "docs", "slot", "doc", "score", "best"])

    return state.groupBy("bundle", "block").cogroup(postings.groupBy("bundle", "block")).applyInArrow(
        add, "bundle long, block long, docs array<long>, slot array<int>, doc array<int>, score array<long>, best array<struct<slot:int,score:long>>")


def selected(state: DataFrame, postings: DataFrame, owner: int, items: int, most: int) -> DataFrame:
    """After the last owner: each item's ``most`` best documents of every block, ties by doc_id (null last)."""

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        scores, taken = accumulated(left, right, owner, items)
        slot, doc = np.nonzero(taken)
        score = scores[slot, doc]
        ids = left.column("docs")[0].values
        unnamed = ids.is_null().to_numpy(zero_copy_only=False)
        named = ids.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((named[doc], unnamed[doc], -score, slot))
        of = slot[order]
        best = order[np.arange(len(of)) - np.searchsorted(of, of) < most]
        bundle = pa.array(np.full(len(best), left.column("bundle")[0].as_py(), np.int64))
        return pa.table([bundle, pa.array(slot[best], pa.int32()), ids.take(pa.array(doc[best])), pa.array(score[best], pa.int64())],
                        ["bundle", "slot", "doc_id", "score"])

    return state.groupBy("bundle", "block").cogroup(postings.groupBy("bundle", "block")).applyInArrow(
        choose, "bundle long, slot int, doc_id long, score long")


def floors(state: DataFrame, most: int) -> DataFrame:
    """For each bundle the score that an item's answers must reach: the ``most``-th best so far, where there are as many."""
    tops = state.select("bundle", F.explode("best").alias("b")).select("bundle", "b.slot", "b.score")
    order = Window.partitionBy("bundle", "slot").orderBy(F.desc("score"))
    last = tops.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    last = last.where(F.col("place") == most).select("bundle", "slot", F.col("score").alias("least"))
    return last.groupBy("bundle").agg(F.collect_list(F.struct("slot", "least")).alias("floors"))


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
           most: int = 20, owners: tuple[int, ...] = OWNERS, block_bits: int = 11, bundle_bits: int = 8) -> DataFrame:
    """item_id, rank, doc_id and score of the ``most`` best documents of every item, those with a score above 0.

    Null and blank texts hold no terms: such a document is never found and counts for nothing, such an item finds nothing. Each row is a
    document or an item of its own: repeated rows of ``docs`` all count and are all found, repeated items are answered each. Ties go
    to the smaller doc_id, a null doc_id last. Other columns are ignored. An empty table gives an empty result.
    """
    asked = written(items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
                    .withColumn("item", F.monotonically_increasing_id()), "items")
    asked = asked.select("*", F.shiftright("item", bundle_bits).alias("bundle"), F.col("item").bitwiseAND((1 << bundle_bits) - 1).cast("int").alias("slot"))
    wanted = written(flat(counted_terms(asked.select("bundle", "slot", "text"), "bundle long, slot int"), "bundle", "slot"), "item-terms")
    only = marked(wanted)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    held = written(counted_terms(rows, "doc_id long", only).withColumn("row", F.monotonically_increasing_id()), "doc-terms")
    held = held.select("*", F.shiftright("row", block_bits).alias("block"), F.col("row").bitwiseAND((1 << block_bits) - 1).cast("int").alias("at"))
    total = held.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()

    length = F.expr(f"75 + (25 * n * {total.docs}L) div {max(1, total.terms)}L")
    gain = F.expr("(1000000000 * tf) div (1000 * tf + 12 * length)")
    postings = (flat(held.withColumn("length", length), "block", "at", "length").withColumn("gain", gain)
                .select("block", "at", "term", "gain"))
    counts = postings.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.max("gain").alias("most"))
    owner = F.lit(len(owners))
    for number, share in reversed(list(enumerate(owners))):
        owner = F.when(F.col("df") * share <= total.docs, number).otherwise(owner)
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * total.docs + 2) / (2 * F.col("df") + 1))).cast("long")
    terms = written(counts.select(F.col("term").alias("word"), "most", owner.alias("owner"), weight.alias("w")).where("w > 0")
                    .withColumn("term", F.monotonically_increasing_id()), "terms")

    weights = written(wanted.withColumnRenamed("term", "word").join(terms, "word").select(
        "bundle", "slot", "owner", "term", "word", (F.col("tf") * F.col("w")).alias("weight"), (F.col("tf") * F.col("w") * F.col("most")).alias("bound")),
        "weights")
    bounds = (weights.groupBy("bundle", "slot", "owner").agg(F.sum("bound").alias("bound"))
              .groupBy("bundle").agg(F.collect_list(F.struct("owner", "slot", "bound")).alias("bounds")))
    bundles = written(weights.groupBy("bundle").agg(F.collect_list(F.struct("owner", "slot", "term", "weight")).alias("query"))
                      .join(bounds, "bundle"), "bundles")
    visited = weights.select("bundle", "owner", "term", F.col("word")).distinct()
    index = written(postings.withColumnRenamed("term", "word").join(visited, "word").select("bundle", "block", "at", "term", "gain", "owner"),
                    "owners", "owner")

    blocks = held.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "doc_id"))).alias("d")).select("block", F.col("d.doc_id").alias("docs"))
    state = written(index.select("bundle", "block").distinct().join(blocks, "block").select(
        "bundle", "block", "docs", F.expr("CAST(array() AS ARRAY<INT>) AS slot"), F.expr("CAST(array() AS ARRAY<INT>) AS doc"),
        F.expr("CAST(array() AS ARRAY<LONG>) AS score")), "bundles-before")
    reached = None
    for number in range(len(owners) + 1):
        empty = F.expr("CAST(array() AS ARRAY<STRUCT<slot: INT, least: LONG>>)")
        carried = state.join(bundles.withColumn("query", F.expr(f"filter(query, q -> q.owner = {number})")), "bundle")
        carried = carried.withColumn("floors", empty) if reached is None else carried.join(reached, "bundle", "left").withColumn(
            "floors", F.coalesce("floors", empty))
        mine = index.where(F.col("owner") == number).select("bundle", "block", "at", "term", "gain")
        if number < len(owners):
            state = written(visit(carried, mine, number, 1 << bundle_bits, most), "bundles-after")
            reached = floors(state, most)
            state = state.drop("best")
        else:
            found = written(selected(carried, mine, number, 1 << bundle_bits, most), "found")
    order = Window.partitionBy("bundle", "slot").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.join(asked.select("bundle", "slot", "item_id"), ["bundle", "slot"]).select("item_id", "rank", "doc_id", "score")
