"""Document quality: random-indexing word vectors, pooled per document, into a two-layer network with calibrated probabilities.

1. *Word vectors.* Every word and every word shape (which kinds of characters it has) owns a fixed sparse index vector of +1 and -1. A
   word's vector is the sum, over all its occurrences in all documents, of the index vectors of its neighbours and their shapes.
   Words are hashed to ``BUCKETS`` rows, so the table has one size for every corpus (BUCKETS x DIM floats, 2 MB) and may be broadcast.
   Tasks add up their own table; Spark sums the tables row by row.
2. *Pooling.* A document is the mean of its words' unit vectors, the mean of its shapes' index vectors, their extremes over stretches
   of ``STRETCH`` words, and how often neighbouring words are equal or repeat.
3. *Network.* tanh hidden layer and logistic output, trained with Adam on at most ``most_rows`` labelled rows (a documented bound;
   the least hashes of doc_id are taken). A fifth of them is set aside to fit the temperature of the probabilities.

Labels come only from rows that are not held out. No label, lang, source or doc_id is an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatwise.llm.common import batches_of
from seatwise.llm.words import mix, text_bytes, word_bounds, word_hashes

BUCKETS, DIM, NONZERO = 1 << 14, 32, 4
STRETCH = 40
#: Bytes of text that a worker takes at once: its arrays take about 110 bytes for each of them.
BATCH = 1 << 18

#: Bits of a word's shape by byte: upper case, lower case, digit, beyond ASCII, and one for each residue of other signs.
KIND = np.array([1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 4 if 48 <= b <= 57 else 8 if b > 127 else 16 << (b % 24)
                 for b in range(256)], np.uint64)


def index_vectors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the NONZERO entries of each hash's index vector."""
    places = np.empty((len(hashes), NONZERO), np.int64)
    signs = np.empty((len(hashes), NONZERO), np.float32)
    for i in range(NONZERO):
        drawn = mix(hashes + np.uint64(0xA0761D6478BD642F * (i + 1) % (1 << 64)))
        places[:, i] = drawn % np.uint64(DIM)
        signs[:, i] = 1 - 2 * ((drawn >> np.uint64(40)) & np.uint64(1)).astype(np.float32)
    return places, signs


def dense(hashes: np.ndarray) -> np.ndarray:
    """Index vectors as rows. Few distinct hashes are expected (shapes)."""
    kinds, which = np.unique(hashes, return_inverse=True)
    places, signs = index_vectors(kinds)
    out = np.zeros((len(kinds), DIM), np.float32)
    np.add.at(out, (np.repeat(np.arange(len(kinds)), NONZERO), places.ravel()), signs.ravel())
    return out[which]


class Words(NamedTuple):
    hashes: np.ndarray
    shapes: np.ndarray
    firsts: np.ndarray
    of: np.ndarray


def words_of(texts: pa.Array) -> Words:
    data, offsets = text_bytes(texts)
    starts, ends, firsts = word_bounds(data, offsets)
    hashes = word_hashes(data, starts, ends)
    if len(starts):
        edges = np.column_stack((starts, ends)).ravel()
        kinds = np.append(KIND[data], np.uint64(0))
        shapes = mix(np.bitwise_or.reduceat(kinds, edges)[::2] + np.uint64(1))
    else:
        shapes = hashes
    return Words(hashes, shapes, firsts, np.repeat(np.arange(len(firsts) - 1), np.diff(firsts)))


def add_contexts(table: np.ndarray, words: Words) -> None:
    """Adds to each word's row the index vectors of the words and shapes next to it in the same text."""
    if len(words.hashes) < 2:
        return
    rows = (words.hashes % np.uint64(BUCKETS)).astype(np.int64)[:, None] * DIM
    together = np.flatnonzero(words.of[1:] == words.of[:-1])
    cells, values = [], []
    for hashes, weight in ((words.hashes, 1), (words.shapes, 2)):
        places, signs = index_vectors(hashes)
        for word, neighbour in ((together, together + 1), (together + 1, together)):
            cells.append((rows[word] + places[neighbour]).ravel())
            values.append((weight * signs[neighbour]).ravel())
    table += np.bincount(np.concatenate(cells), weights=np.concatenate(values), minlength=BUCKETS * DIM)


def word_vectors(docs: DataFrame, text: str) -> np.ndarray:
    """The BUCKETS x DIM table of unit word vectors over all documents."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS * DIM)
        for whole in batches:
            for batch in batches_of(whole, "text", BATCH):
                add_contexts(table, words_of(batch.column("text")))
        table = table.reshape(BUCKETS, DIM).astype(np.float32)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used)] + [pa.array(table[used, i]) for i in range(DIM)],
                                         ["bucket"] + [f"v{i}" for i in range(DIM)])

    schema = "bucket long, " + ", ".join(f"v{i} float" for i in range(DIM))
    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(add, schema)
    sums = parts.groupBy("bucket").agg(*[F.sum(f"v{i}").cast("float").alias(f"v{i}") for i in range(DIM)]).toPandas()
    table = np.zeros((BUCKETS, DIM), np.float32)
    table[sums["bucket"].to_numpy()] = sums.drop(columns="bucket").to_numpy()
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-6)


WIDTH = 4 * DIM + 4


def pooled(words: Words, vectors: np.ndarray) -> np.ndarray:
    """One row of WIDTH numbers per text; a text without words has zeros."""
    n = np.diff(words.firsts)
    out = np.zeros((len(n), WIDTH), np.float32)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    heads = words.firsts[:-1][full]
    each = n[full][:, None]
    by_word = vectors[(words.hashes % np.uint64(BUCKETS)).astype(np.int64)]
    by_shape = dense(words.shapes)
    out[full, :DIM] = np.add.reduceat(by_word, heads) / each
    out[full, DIM:2 * DIM] = np.add.reduceat(by_shape, heads) / each
    place = np.arange(len(words.hashes)) - words.firsts[words.of]
    cuts = np.flatnonzero(place % STRETCH == 0)
    stretch = np.add.reduceat(by_shape, cuts) / np.diff(np.append(cuts, len(place)))[:, None]
    at = np.searchsorted(cuts, heads)
    out[full, 2 * DIM:3 * DIM] = np.maximum.reduceat(stretch, at)
    out[full, 3 * DIM:4 * DIM] = np.minimum.reduceat(stretch, at)
    same = np.zeros(len(place), np.float32)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.of[1:] == words.of[:-1])
    out[full, -4] = np.add.reduceat(same, heads) / n[full]
    out[full, -3] = np.maximum.reduceat(np.add.reduceat(same, cuts) / STRETCH, at)
    out[full, -2] = np.log1p(n[full])
    out[full, -1] = np.linalg.norm(out[full, :DIM], axis=1)
    return out


class Network(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 40, seed: int = 7) -> Network:
    """Fits the network. With one class only, or no rows, every probability is the smoothed share of label 1."""
    x = x.astype(np.float64)
    if len(np.unique(y)) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Network(np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(y))
    aside, fit = order[:len(y) // 5], order[len(y) // 5:]
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    x = np.clip((x - mean) / scale, -8, 8)
    state = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), draw.normal(0, 0.3, hidden), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in state], [np.zeros_like(p) for p in state], 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        for rows in np.array_split(draw.permutation(fit), max(1, len(fit) // 128)):
            a, target = x[rows], y[rows]
            h = np.tanh(a @ state[0] + state[1])
            gap = (1 / (1 + np.exp(-(h @ state[2] + state[3][0]))) - target) / len(rows)
            back = gap[:, None] * state[2] * (1 - h * h)
            slopes = [a.T @ back + 1e-4 * state[0], back.sum(axis=0), h.T @ gap + 1e-4 * state[2], np.array([gap.sum()])]
            step += 1
            for i, slope in enumerate(slopes):
                first[i] += 0.1 * (slope - first[i])
                second[i] += 0.001 * (slope * slope - second[i])
                state[i] = state[i] - rate * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    w1 = state[0] / scale[:, None]
    net = Network(np.zeros(x.shape[1]), np.ones(x.shape[1]), w1, state[1] - mean @ w1, state[2], float(state[3][0]), 1.0)
    if len(aside):
        raw = np.tanh(x[aside] @ state[0] + state[1]) @ state[2] + state[3][0]
        choices = np.geomspace(0.25, 8, 60)
        net = net._replace(temperature=float(choices[np.argmin([loss(raw / t, y[aside]) for t in choices])]))
    return net


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels are never learnt from; a null doc_id is one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


class Model(NamedTuple):
    vectors: np.ndarray
    net: Network

    def scores(self, texts: pa.Array) -> np.ndarray:
        return self.net.probabilities(pooled(words_of(texts), self.vectors).astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        most_rows: int = 20_000) -> Model:
    """Word vectors of all of ``docs``, and the network of at most ``most_rows`` labelled rows that are not held out.

    Null labels, and labels of one doc_id that contradict each other, are not learnt from.
    """
    vectors = word_vectors(docs, text)
    known = (labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("known"))
             .agg(F.min(label).alias("y"), F.max(label).alias("other")).where("y = other"))
    taken = known.select("known", F.col("y").cast("int").alias("y")).orderBy(F.xxhash64("known"), "known").limit(most_rows)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text", BATCH):
                x = pooled(words_of(batch.column("text")), vectors)
                yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], ["y", "x"])

    rows = docs.select(F.col(doc_id).alias("known"), F.col(text).cast("string").alias("text"))
    # F.broadcast is safe: ``taken`` has at most most_rows rows of twelve bytes.
    sample = rows.join(F.broadcast(taken), "known").select("y", "text").mapInArrow(pool, "y int, x binary").collect()
    sample.sort(key=lambda r: (r["y"], bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in sample], np.float32).reshape(-1, WIDTH)
    return Model(vectors, train(x, np.array([r["y"] for r in sample], np.float64)))


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
                    most_rows: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold) for every row.

    Null and blank texts are texts without words and get the score the network gives to zeros. Repeated rows all come back, equal texts
    with equal scores. A null doc_id is held out. Without both labels every score is the smoothed share of label 1 (0.5 without
    any). Other columns are ignored. An empty table gives no rows.
    """
    model = fit(docs, labels, doc_id, text, label, most_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text", BATCH):
                found = pa.array(model.scores(batch.column("text")), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
             most_rows: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with all their columns."""
    model = fit(docs, labels, doc_id, text, label, most_rows)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, text, BATCH):
                yield batch.filter(pa.array(model.scores(batch.column(text)) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
