"""SimHash near-duplicates by Golay-code fuzzy hashing.

1. A text's fingerprint has a bit set if over half of its three-word shingles have it set in their XXH64. Documents with one
   fingerprint are one *node* from here on, so a group of copies, however large, costs one row.
2. The 64 bits are cut into segments of 22, 21 and 21 bits. Two fingerprints with at most two differing bits agree in one segment at
   least (pigeonhole), and in the segment after it they differ in two bits at most.
3. The perfect binary Golay code of length 23 covers every word within three bits. A segment (filled up with zeros) is decoded to the
   numbers of all codewords within four bits: one if its nearest codeword is at most two bits away, else that one and five others.
   Two segments that differ in at most two bits have a word between them, one bit from each at most; the codeword within three bits of
   that word is within four of both. So both are given that codeword's number: a key is an error-free segment with a codeword number
   of the next segment, 16 keys a fingerprint on average, and no link is missed.
4. Keys are joined and links verified on the whole fingerprints. A short list compares its members with each other, which is bounded. In a long list
   no pairs are made: each member offers itself and the 64 words one bit away, and meets the least member that offers the same word.
   Two fingerprints that offer one word differ in at most two bits, and two that differ in at most two bits offer a common one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatwise.llm.common import batches_of, written
from seatwise.llm.components import components
from seatwise.llm.words import lowered, text_bytes, word_bounds

SHINGLE = 3
SEED = 42
#: First bit and width of each segment of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
LENGTH = 23


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of every text, and how many shingles precede each text. Fewer words than a shingle are one, none are none."""
    data, offsets = text_bytes(texts)
    starts, ends, firsts = word_bounds(data, offsets)
    lengths = ends - starts
    at = np.cumsum(lengths + 1) - lengths - 1
    spaced = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    spaced[np.repeat(at, lengths) + within] = lowered(data)[np.repeat(starts, lengths) + within]
    counts = np.diff(firsts)
    text = np.repeat(np.arange(len(counts)), counts)
    word = np.arange(len(starts))
    last = firsts[1:][text] - 1
    first_of_one = (word + SHINGLE - 1 <= last) | (word == firsts[:-1][text])
    begins = word[first_of_one]
    stops = np.minimum(begins + SHINGLE - 1, last[first_of_one])
    joined = spaced.tobytes()
    hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(at[begins].tolist(), (at + lengths)[stops].tolist(), strict=True)]
    return np.array(hashes, np.uint64), np.searchsorted(text[begins], np.arange(len(counts) + 1))


def majority(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """For each text the 64-bit word of the bits set in over half of its hashes; zero for a text without any."""
    filled = np.flatnonzero(np.diff(firsts))
    out = np.zeros(len(firsts) - 1, np.uint64)
    if len(filled):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_in = np.add.reduceat(bits, firsts[:-1][filled], axis=0, dtype=np.int64)
        more = 2 * set_in > np.diff(firsts)[filled][:, None]
        out[filled] = np.packbits(more, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the fingerprint, as a signed number, of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text"):
                words = majority(*shingle_hashes(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.view(np.int64))], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(sign, "doc_id long, fingerprint long")


@lru_cache(maxsize=1)
def decoder() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The syndrome of every single bit; for each syndrome the error patterns of at most four bits that lead from a word to a codeword,
    nearest first, and how many there are (1 or 6)."""
    single = []
    for bit in range(LENGTH):
        word = 1 << bit
        for shift in range(LENGTH - 1, 10, -1):
            if word >> shift & 1:
                word ^= GENERATOR << (shift - 11)
        single.append(word)
    patterns: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            syndrome = 0
            for bit in bits:
                syndrome ^= single[bit]
            patterns[syndrome].append(sum(1 << bit for bit in bits))
    counts = np.array([len(x) for x in patterns])
    table = np.array([x + [0] * (6 - len(x)) for x in patterns], np.int64)
    return np.array(single, np.int64), table, counts


def codeword_numbers(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit word the numbers (0 to 4095) of the codewords within four bits, in six columns, and how many of them count."""
    single, table, counts = decoder()
    syndrome = np.zeros(len(words), np.int64)
    for bit in range(LENGTH):
        syndrome ^= np.where(words >> bit & 1, single[bit], 0)
    return (words[:, None] ^ table[syndrome]) >> 11, counts[syndrome]


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row and key of every posting: number of the segment taken as free of errors, its bits, a codeword number of the next one."""
    rows, out = [], []
    segment = [(words >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64) for first, width in SEGMENTS]
    for i in range(len(SEGMENTS)):
        numbers, counts = codeword_numbers(segment[(i + 1) % len(SEGMENTS)])
        row = np.repeat(np.arange(len(words)), counts)
        rows.append(row)
        out.append(i << 40 | segment[i][row] << 12 | numbers[np.arange(6)[None, :] < counts[:, None]])
    return np.concatenate(rows), np.concatenate(out)


def posted(nodes: DataFrame) -> DataFrame:
    """token and node for every key of every fingerprint ``node``."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
            rows, tokens = keys(words)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(words[rows].view(np.int64))], ["token", "node"])

    return nodes.select("node").mapInArrow(post, "token long, node long")


def differ_little(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= 2


def links(nodes: DataFrame, list_size: int = 16) -> DataFrame:
    """Pairs (a, b) of fingerprints that differ in one or two bits, enough of them to join all that are linked."""
    posts = written(posted(nodes), "golay")
    lists = posts.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where("size > 1")

    short = (posts.join(lists.where(F.col("size") <= list_size).select("token"), "token", "left_semi")
             .groupBy("token").agg(F.collect_list("node").alias("all")))
    pairs = F.flatten(F.transform("all", lambda a, i: F.transform(
        F.filter(F.slice("all", i + 2, F.size("all")), lambda b: differ_little(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    near = short.select(F.explode(pairs).alias("pair")).select("pair.a", "pair.b")

    long = posts.join(lists.where(F.col("size") > list_size).select("token"), "token", "left_semi").select("node").distinct()
    flips = F.array(*[F.lit(flip).cast("long") for flip in (0, *(1 << bit for bit in range(63)), -1 << 63)])
    offers = long.select("node", F.explode(F.transform(flips, lambda flip: F.col("node").bitwiseXOR(flip))).alias("word"))
    least = offers.groupBy("word").agg(F.min("node").alias("a"))
    met = offers.join(least, "word").select("a", F.col("node").alias("b")).where((F.col("a") != F.col("b")) & differ_little(F.col("a"), F.col("b")))
    return near.unionByName(met).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", list_size: int = 16) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of ``docs``.

    Fingerprints with at most two differing bits are linked; component_id is the least doc_id reachable, itself included. Null, empty
    and blank texts have fingerprint zero and are linked like any other. Repeated rows come back as often as they are given, rows of
    one doc_id with different texts each with their own text's component. A null doc_id takes part through its text: its component is
    the least doc_id of its group, or null where the group has none. Other columns are ignored. An empty table gives an empty result.
    """
    rows = written(fingerprints(docs, doc_id, text), "fingerprints")
    nodes = rows.groupBy(F.col("fingerprint").alias("node")).agg(F.min("doc_id").alias("least"))
    joined = components(written(links(nodes, list_size=list_size), "golay-links"), "a", "b")
    labelled = written(nodes.join(joined, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label")), "labelled")
    groups = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = labelled.join(groups, "label").select(F.col("node").alias("fingerprint"), "component_id")
    return rows.join(named, "fingerprint").select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
