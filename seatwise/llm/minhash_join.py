"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

1. Each text becomes the set of its distinct five-word shingles (64-bit hashes) and a signature of ``coordinates`` values, each a hash of
   ``minima`` min-hashes, so that texts which only share a passage rarely agree in one. Texts with equal sets are one *representative*
   from here on, so a group of copies, however large, costs one row.
2. Every representative is posted under each of its coordinate-value pairs. Two representatives are candidates if at least ``matches``
   coordinates collide. As in prefix filtering, pairs found nowhere else count for nothing; the others are ranked by how many
   representatives hold them, and only the rarest (held - matches + 1) are posted: two signatures with ``matches`` collisions meet in one.
3. Merging skips what is decided. First each list meets its least member (a star, never all pairs); their agreeing min-hashes are counted
   (by one byte of each) and pairs with ``agree`` or more confirmed on the full sets. In lists that still hold several components, members
   that share too few shingles with other components to be linked with any of them drop out (``linkable``). While that joins something, each
   list then offers another member of its largest component to those outside, which try the most alike of each component. What still holds
   several components is joined, members outside a list's largest component against members of other components, where counts of common
   shingles by hash bucket allow a link (``crossings``); the rest is confirmed, so every link that could still join two components is tried.
   Links inside a component change no answer and are skipped.

A pair of similarity 0.75 agrees in 0.75 ** 3 of 42 coordinates, 17.7 on average; fewer than 3 happen with a chance of about 5e-8. It agrees
in 94 of 126 min-hashes on average; fewer than 68 happen with a chance of about 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatwise.llm.common import batches_of, written
from seatwise.llm.components import components
from seatwise.llm.words import lowered, mix, text_bytes, word_bounds, word_hashes

SHINGLE = 5
BUCKETS = 128
#: Places in the bit set that says which texts a step needs: at most 262,144 whole numbers, whatever the table's size.
MARKS = 1 << 24


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than a shingle are one shingle, no words none."""
    data, offsets = text_bytes(texts)
    starts, ends, firsts = word_bounds(data, offsets)
    words = word_hashes(lowered(data), starts, ends)
    value = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE):
        value = mix(value + words[i:i + len(value)])
    for first, last in zip(firsts[:-1], firsts[1:], strict=True):
        if last - first >= SHINGLE:
            yield np.unique(value[first:last - SHINGLE + 1])
        elif last > first:
            whole = np.array([last - first], np.uint64)
            for word in words[first:last]:
                whole = mix(whole + word)
            yield whole
        else:
            yield np.zeros(0, np.uint64)


def coordinate_seeds(coordinates: int, minima: int) -> tuple[np.ndarray, np.ndarray]:
    count = coordinates * minima
    seeds = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return seeds[:count, None] | np.uint64(1), seeds[count:, None]


def signature(shingles: np.ndarray, seeds: tuple[np.ndarray, np.ndarray], minima: int) -> tuple[np.ndarray, np.ndarray]:
    """Each coordinate's number and least hash values over a set that is not empty, as one hash, and the last byte of every least value;
    very large sets go in parts."""
    times, plus = seeds
    least = None
    for i in range(0, len(shingles), 1 << 12):
        part = ((times * shingles[None, i:i + (1 << 12)] + plus) >> np.uint64(32)).min(axis=1)
        least = part if least is None else np.minimum(least, part)
    low = least.astype(np.uint8).view(np.int8)
    least = least.reshape(-1, minima)
    value = np.arange(1, len(least) + 1, dtype=np.uint64)
    for i in range(minima):
        value = mix(value + least[:, i] * np.uint64(0x9E3779B97F4A7C15))
    return value.view(np.int64), low


def signed(docs: DataFrame, doc_id: str, text: str, coordinates: int, minima: int) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, two 64-bit sums that name the set, its signature and the bytes of its minima (null for an empty set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = coordinate_seeds(coordinates, minima)
        for whole in batches:
            for batch in batches_of(whole, "text"):
                counts, first, second, rows, lows = [], [], [], [], []
                for shingles in shingle_sets(batch.column("text")):
                    counts.append(len(shingles))
                    first.append(int(shingles.sum(dtype=np.uint64)) - (1 << 63))
                    second.append(int(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) - (1 << 63))
                    row, low = signature(shingles, seeds, minima) if len(shingles) else (None, None)
                    rows.append(row)
                    lows.append(low)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text_hash"), pa.array(counts, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
                     pa.array(rows, pa.list_(pa.int64())), pa.array(lows, pa.list_(pa.int8()))], ["doc_id", "text_hash", "n_shingles", "k1", "k2", "signature", "low"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, k1 long, k2 long, signature array<long>, low array<tinyint>")


def marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose node stands in ``wanted``, and a few whose hash meets that of one that does: a bit set of fixed size is sent to the
    rows, so no row is shuffled. For steps that join with the nodes themselves afterwards."""
    def at(cut: str) -> Column:
        return F.expr(f"{cut.format(f'pmod(xxhash64(node), {MARKS}L)')}")
    bits = wanted.select(at("shiftright({}, 6)").alias("_word"), at("shiftleft(1L, cast({} & 63 as int))").alias("_bit"))
    bits = F.broadcast(bits.groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    return rows.join(bits, (at("shiftright({}, 6)") == F.col("_word")) & (F.getbit("_bits", at("cast({} & 63 as int)")) == 1), "left_semi")


def full_sets(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """node and its whole shingle set, for the documents named in ``wanted`` (column node) and a few others (see ``marked``)."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text"):
                sets = list(shingle_sets(batch.column("text")))
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))],
                    ["node", "shingles"])

    rows = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).cast("string").alias("text"))
    return marked(rows.where("node is not null"), wanted).mapInArrow(shingle, "node long, shingles array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    sets = written(full_sets(docs, doc_id, text, wanted), "shingles")
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b"))
    common = F.size(F.array_intersect("x", "y")).cast("long")
    return (both.select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), common.alias("common"))
            .where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("nx") + F.col("ny") - F.col("common")))
            .select("a", "b").distinct())


def agreeing(pairs: DataFrame, lows: DataFrame, agree: int) -> DataFrame:
    """The pairs (a, b, and what else their rows hold) with at least ``agree`` equal bytes of min-hashes, and how many they are."""
    both = (pairs.join(lows.select(F.col("node").alias("a"), F.col("low").alias("x")), "a")
            .join(lows.select(F.col("node").alias("b"), F.col("low").alias("y")), "b"))
    equal = F.aggregate(F.zip_with("x", "y", lambda p, q: (p == q).cast("int")), F.lit(0), lambda n, e: n + e)
    return both.withColumn("equal", equal).where(F.col("equal") >= agree).drop("x", "y")


def undecided(postings: DataFrame, near: DataFrame, least: int) -> DataFrame:
    """token, node, label and most (the label of the list's largest component) in lists of ``least`` and more that still hold several components."""
    marked = postings.join(near, "node", "left").select("token", "node", F.coalesce("label", "node").alias("label"))
    shares = marked.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = (shares.groupBy("token").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("labels"), F.sum("n").alias("size"))
               .where(f"labels > 1 and size >= {least}").select("token", "most"))
    return marked.join(largest, "token")


def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each bucket stands in ``common``, as an array."""
    for batch in batches:
        counts = [np.bincount(row, minlength=BUCKETS).astype(np.int32) for row in batch.column("common").to_numpy(zero_copy_only=False)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.list_(pa.int32()))], ["node", "n", "r", "counts"])


def linkable(mixed: DataFrame, docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """node, n (shingles), r (those that a node of another component holds too) and their counts by hash bucket, of the nodes that a link could
    still join to another component.

    A link takes common shingles of at least ``percent`` of either set, and only those that another component holds can be common. Nodes with
    fewer are left out, whose shingles then no longer count for the others, until no more than a tenth goes. Nothing is compared in pairs.
    """
    nodes = mixed.select("node", "label").distinct()
    sets = written(full_sets(docs, doc_id, text, nodes).join(nodes, "node"), "mixed-sets")
    sizes = sets.groupBy("node").agg(F.min(F.size("shingles")).alias("n"))
    before = None
    while True:
        terms = sets.select("node", "label", F.explode("shingles").alias("shingle"))
        foreign = terms.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("shingle")
        common = terms.join(foreign, "shingle", "left_semi").groupBy("node").agg(F.collect_list(F.pmod("shingle", F.lit(BUCKETS)).cast("int")).alias("common"))
        shared = common.select("node", F.size("common").alias("r"), "common").join(sizes, "node").where(F.lit(100) * F.col("r") >= F.lit(percent) * F.col("n"))
        able = written(shared.select("node", "n", "r", "common").mapInArrow(profile, "node long, n int, r int, counts array<int>"), "linkable")
        count = able.count()
        if not count or (before is not None and 10 * count > 9 * before):
            return able
        sets, before = sets.join(able.select("node"), "node", "left_semi"), count


def offered(mixed: DataFrame, turn: int) -> DataFrame:
    """a, b, m and of: a member of each list's largest component, drawn by a hash of the list and turn, with every member outside of it."""
    centres = mixed.where("label = most").groupBy("token").agg(F.min_by("node", F.xxhash64("node", "token", F.lit(turn))).alias("c"))
    return (mixed.where("label != most").join(centres, "token")
            .select(F.least("c", "node").alias("a"), F.greatest("c", "node").alias("b"), F.col("node").alias("m"), F.col("most").alias("of")).distinct())


def crossings(mixed: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of two components that meet in a list, members outside its largest component with all others, and could hold as many
    common shingles as a link takes: no more than the lesser count of each bucket. The join itself drops the rest."""
    minor = mixed.where("label != most").select("token", F.col("node").alias("m"), F.col("label").alias("of"), F.col("n").alias("m_n"),
                                                F.col("r").alias("m_r"), F.col("counts").alias("m_counts"))
    needed = F.lit(percent) * (F.col("n") + F.col("m_n"))
    most = F.aggregate(F.zip_with("counts", "m_counts", lambda x, y: F.least(x, y)), F.lit(0), lambda total, c: total + c)
    possible = (F.lit(100 + percent) * F.least("r", "m_r") >= needed) & (F.lit(100 + percent) * most >= needed)
    return (minor.join(mixed, "token").where(F.expr("label != of and (label = most or m < node)") & possible)
            .select(F.least("m", "node").alias("a"), F.greatest("m", "node").alias("b")).distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", coordinates: int = 42, minima: int = 3,
                    matches: int = 3, agree: int = 68, percent: int = 75, rounds: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and a hash of the text for every row of ``docs``.

    Two documents are linked if their sets of distinct five-word shingles have 100 * intersection >= percent * union;
    component_id is the least doc_id reachable over links, itself included, and kept says that it is the row's own.

    Null and blank texts have an empty set and are linked with nothing. Repeated rows come back as often as they are given, with one
    component. A null doc_id takes part through its text: its component is the least doc_id of its group, or null with kept true
    where the group has none. Other columns are ignored. An empty table gives an empty result.
    """
    rows = written(signed(docs, doc_id, text, coordinates, minima), "signed")
    key = ["k1", "k2", "n_shingles"]
    groups = rows.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(
        F.min(F.struct("doc_id", "signature", "low")).alias("least"))
    reps = written(groups.select(*key, F.col("least.doc_id").alias("node"), F.col("least.signature").alias("signature"), F.col("least.low").alias("low")), "reps")
    lows = reps.select("node", "low")

    posts = reps.select("node", F.explode("signature").alias("token"))
    held = posts.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranked = (posts.join(held, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("held"))
              .where(F.size("held") >= matches))
    postings = written(ranked.select("node", F.explode(F.slice("held", F.lit(1), F.size("held") - matches + 1)).alias("h"))
                       .select("node", F.col("h.token").alias("token")), "postings")

    lists = postings.groupBy("token").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1")
    stars = postings.join(lists.select("token", "a"), "token").where("node > a").select("a", F.col("node").alias("b")).distinct()
    tried = written(agreeing(stars, lows, agree).select("a", "b"), "stars")
    found = written(confirmed(tried, docs, doc_id, text, percent), "confirmed")
    near = components(found, "a", "b")

    mixed = written(undecided(postings, near, 3), "mixed")  # of a list of two all is known
    able = linkable(mixed, docs, doc_id, text, percent)
    postings = written(mixed.join(able, "node").select("token", "node"), "open")
    mixed = written(undecided(postings, near, 2), "mixed")
    for turn in range(rounds):
        best = written(agreeing(offered(mixed, turn), lows, agree).groupBy("m", "of")
                       .agg(F.max_by(F.struct("a", "b"), F.struct("equal", "a", "b")).alias("pair")).select("pair.a", "pair.b").distinct(), "offered")
        more = written(confirmed(best, docs, doc_id, text, percent), "confirmed")
        tried, found = tried.unionByName(best), found.unionByName(more)
        if 10 * more.count() < best.count():  # what is left are mostly families without links, which no other offer joins
            break
        near = components(found, "a", "b")
        mixed = written(undecided(postings, near, 2), "mixed")

    crossing = written(crossings(mixed.join(able, "node"), percent).join(tried, ["a", "b"], "left_anti"), "crossing")
    rest = written(confirmed(crossing, docs, doc_id, text, percent), "confirmed")
    near = components(found.unionByName(rest), "a", "b")

    labels = reps.select(*key, "node").join(near, "node", "left").select(*key, F.coalesce("label", "node").alias("label"))
    labelled = rows.drop("signature", "low").join(labels, key, "left")
    return labelled.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"),
                        F.coalesce("label", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"), "text_hash")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; of rows with one doc_id and one text, one.

    Join and deduplication have the same keys, none of them null, so whole texts are shuffled once for both.
    """
    def keyed(df: DataFrame, id: str, hashed: Column) -> DataFrame:
        number = F.col(id).cast("long")
        return df.withColumns({"_id": F.coalesce(number, F.lit(0)), "_none": number.isNull(), "_hash": hashed})

    keys = ["_id", "_none", "_hash"]
    kept = keyed(near_duplicates(docs, doc_id, text, **how).where("kept"), "doc_id", F.col("text_hash")).select(*keys).distinct()
    rows = keyed(docs, doc_id, F.xxhash64(F.col(text).cast("string")))
    return rows.join(kept, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
