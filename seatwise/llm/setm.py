"""Phrase collocations by SETM, set-oriented mining with sorted relations.

1. The words of all texts are numbered and kept as a relation of occurrences (block, place, word), sorted by place and stored in the
   buckets of its block. A block holds whole texts of one language; its relation is one row whose array index is the place, and a
   place without a word (-1) stands between pieces, so words of two pieces never stand at adjacent places.
2. For each length the relation of phrases is merge-joined with that of words on block and adjacent place: both are sorted by place, so
   the join is a shift. Occurrences are grouped and counted inside the block first, then over all blocks; a phrase thus reaches
   the count at most once per block, however frequent it is.
3. Groups with at least ``least`` occurrences are frequent. They are semi-joined back to the blocks they come from, and only their
   occurrences are kept (again sorted, in buckets) and extended to the next length. No part of a frequent phrase is rarer than the phrase.
4. Scores, containment in longer phrases and ranks are joins and aggregates over the frequent phrases alone.

Words get whole numbers, so phrases are compared exactly. Relations are tables of the shared folder; as both sides of a merge-join lie
in buckets of the block, occurrences are never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seatwise.llm.byte_runs import byte_class, numbered, runs
from seatwise.llm.common import batches_of, shared_folder, shuffle_partitions, written
from seatwise.llm.words import lowered, text_bytes

#: Bytes that end a piece, and those that separate words inside one.
PIECE_ENDS = byte_class(b".,;:!?\x0a\x0b\x0c\x0d")
SPACES = byte_class(b"\x20\x09")
UNKNOWN = "und"
BLOCK_BYTES = 4 << 20
#: floor(1000000 a a / (l r)) in whole decimals.
SCORE = "CAST((CAST(a AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0)) * 1000000) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0))) AS BIGINT)"


def in_buckets(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` from a table of the shared folder that lies in buckets of ``block``: joins on the block move none of them."""
    spark, unique = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    (df.write.format("parquet").option("path", f"{shared_folder(spark)}/{unique}")
     .bucketBy(shuffle_partitions(spark), "block").saveAsTable(unique))
    return spark.table(unique)


def numbered_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word numbers by place with -1 between pieces, the words by number, and how often each occurs."""
    data, offsets = text_bytes(texts)
    ends_piece = PIECE_ENDS[data]
    inside = ~(ends_piece | SPACES[data])
    starts, ends, firsts = runs(inside, offsets)
    numbers, words = numbered(lowered(data), inside, starts, ends)
    pieces = np.cumsum(ends_piece, dtype=np.int32)[starts] + np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    breaks = np.flatnonzero(np.diff(pieces)) + 1
    return np.insert(numbers, breaks, -1), words, np.bincount(numbers, minlength=len(words))


def listed(*columns: np.ndarray | pa.Array) -> list[pa.Array]:
    """Each column as the only entry of a list column."""
    columns = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
    return [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]


def occurrences(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """One row for each block: its language, the word numbers by place, and the block's words with their counts."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text", BLOCK_BYTES):
                for name in pc.unique(batch.column("lang")).to_pylist():
                    texts = batch.filter(pc.equal(batch.column("lang"), name)).column("text")
                    places, words, counts = numbered_words(texts)
                    if len(places):
                        yield pa.RecordBatch.from_arrays([pa.array([name]), *listed(places.astype(np.int32), words.cast(pa.string()), counts)],
                                                         ["lang", "place", "word", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    return (rows.where("text IS NOT NULL").mapInArrow(blocks, "lang string, place array<int>, word array<string>, n array<long>")
            .withColumn("block", F.monotonically_increasing_id()))


def frequent(groups: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The rows of ``groups`` (block, number, keys, n) whose keys occur at least ``least`` times over all blocks, with that total a and an
    id of the group. A group has one row per block, so a window over it holds no occurrences."""
    total = Window.partitionBy(*keys)
    totals = groups.withColumn("id", F.monotonically_increasing_id()).select(
        "block", "number", *keys, F.sum("n").over(total).alias("a"), F.min("id").over(total).alias("id"))
    return written(totals.where(F.col("a") >= least), "frequent")


def by_block(held: DataFrame) -> DataFrame:
    """For each block its numbers that are frequent and the ids they stand for; a block has no more of them than places."""
    return (held.groupBy("block").agg(F.collect_list(F.struct("number", "id")).alias("held"))
            .select("block", F.col("held.number").alias("number"), F.col("held.id").alias("id")))


def arrays(batch: pa.RecordBatch, *names: str) -> Iterator[list[np.ndarray]]:
    """The named list columns of each row as arrays."""
    for i in range(batch.num_rows):
        yield [batch.column(name)[i].values.to_numpy(zero_copy_only=False) for name in names]


def pruned(numbers: np.ndarray, number: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in the order of their numbers, and for each of ``numbers`` its place among them, -1 where it is not among them."""
    order = np.argsort(number)
    rank = np.full(int(max(numbers.max(initial=-1), number.max(initial=-1))) + 2, -1, np.int32)
    rank[number[order]] = np.arange(len(order), dtype=np.int32)
    return rank[numbers], ids[order]  # -1 meets the last entry, which is -1


def frequent_words(blocks: DataFrame, kept: DataFrame) -> DataFrame:
    """The relation of words without the rare ones: block, word (a number by place) and word_id (by number)."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (place, number, ids) in enumerate(arrays(batch, "place", "number", "id")):
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(i, 1), *listed(*pruned(place, number, ids))], ["block", "word", "word_id"])

    return in_buckets(blocks.select("block", "place").join(kept, "block").mapInArrow(prune, "block long, word array<int>, word_id array<long>"), "words")


def merge_joined(phrase: np.ndarray, word: np.ndarray, length: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The places at which a phrase of ``length`` words is followed by a word, and both numbers as one."""
    at = np.flatnonzero((phrase[:max(0, len(phrase) - length)] >= 0) & (word[length:] >= 0))
    return at, phrase[at].astype(np.int64) * n_words + word[at + length]


def counted(relation: DataFrame, words: DataFrame, length: int) -> DataFrame:
    """The distinct phrases of every block that are one word longer: their number in the block, the id of the phrase before the last
    word, that of the word, and their occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (phrase, phrase_id, word, word_id) in enumerate(arrays(batch, "phrase", "phrase_id", "word", "word_id")):
                _, both = merge_joined(phrase, word, length, len(word_id))
                found, counts = np.unique(both, return_counts=True)
                if len(found):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(found), batch.column("block")[i].as_py())), pa.array(np.arange(len(found), dtype=np.int32)),
                         pa.array(phrase_id[found // len(word_id)]), pa.array(word_id[found % len(word_id)]), pa.array(counts)],
                        ["block", "number", "before", "last", "n"])

    return relation.join(words, "block").mapInArrow(count, "block long, number int, before long, last long, n long")


def longer(relation: DataFrame, words: DataFrame, kept: DataFrame, length: int) -> DataFrame:
    """The relation of phrases one word longer, without the rare ones: block, phrase (a number by place) and phrase_id."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (phrase, word, word_id, number, ids) in enumerate(arrays(batch, "phrase", "word", "word_id", "number", "id")):
                at, both = merge_joined(phrase, word, length, len(word_id))
                ranks, ids = pruned(np.unique(both, return_inverse=True)[1], number, ids)
                places = np.full(len(phrase), -1, np.int32)
                places[at] = ranks
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(i, 1), *listed(places, ids)], ["block", "phrase", "phrase_id"])

    joined = relation.select("block", "phrase").join(words, "block").join(kept, "block")
    return in_buckets(joined.mapInArrow(extend, "block long, phrase array<int>, phrase_id array<long>"), "longer")


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """lang, words (array) and a of every phrase of 1 to ``longest`` words with at least ``least`` occurrences, and n of every language."""
    blocks = in_buckets(occurrences(docs, text, lang), "occurrences")
    totals = blocks.select("lang", F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    vocabulary = blocks.select("lang", "block", F.posexplode(F.arrays_zip("word", "n")).alias("number", "w")).select(
        "lang", "block", "number", F.col("w.word").alias("word"), F.col("w.n").alias("n"))
    held = frequent(vocabulary, ["lang", "word"], least)
    words = frequent_words(blocks, by_block(held))
    names = held.select("id", "lang", "word", "a").distinct()
    levels = [names.select("lang", F.array("word").alias("words"), "a", "id")]
    relation = words.select("block", F.col("word").alias("phrase"), F.col("word_id").alias("phrase_id"))
    for length in range(1, longest):
        held = frequent(counted(relation, words, length), ["before", "last"], least)
        levels.append(written(
            held.select("before", "last", "a", "id").distinct()
            .join(levels[-1].select(F.col("id").alias("before"), "lang", "words"), "before")
            .join(names.select(F.col("id").alias("last"), "word"), "last")
            .select("lang", F.concat("words", F.array("word")).alias("words"), "a", "id"), "phrases"))
        if length + 1 < longest:
            relation = longer(relation, words, by_block(held), length)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every.drop("id"), totals


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, percent: int = 50,
                 most: int = 2000) -> DataFrame:
    """Each language's first ``most`` phrases: lang, rank, phrase, a, l, r, n and score.

    Null, empty and blank texts hold no words. A null language is ``und``, together with rows that say so. Repeated rows count as often as
    they are given. Other columns are ignored. Ties go by a, then by the phrase's bytes. A table without words gives an empty result.
    """
    every, totals = phrases(docs, text, lang, longest, least)
    every = written(every, "every-phrase")
    candidates = every.where(F.size("words") > 1)

    cut = candidates.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cut = cut.select("*", F.slice("words", F.lit(1), F.col("k")).alias("first"), F.slice("words", F.col("k") + 1, F.size("words")).alias("rest"))
    part = every.select("lang", "words", "a")
    scored = (cut.join(part.select("lang", F.col("words").alias("first"), F.col("a").alias("l")), ["lang", "first"])
              .join(part.select("lang", F.col("words").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
              .withColumn("score", F.expr(SCORE)))
    lowest = scored.groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = candidates.where(F.size("words") > 2).select("lang", "a", "words", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("size"))
    inner = inner.select("lang", "a", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1),
                                                            lambda i: F.slice("words", i, F.col("size")))).alias("words"))
    longer = inner.groupBy("lang", "words").agg(F.max("a").alias("longer"))
    left = (lowest.join(longer, ["lang", "words"], "left").where(F.expr(f"longer IS NULL OR 100 * longer < {int(percent)} * a"))
            .select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.*"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
