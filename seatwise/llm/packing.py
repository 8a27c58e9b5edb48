"""Packing documents into token sequences as a cutting-stock problem, solved by column generation.

1. Texts are tokenized where they lie. A document is cut into full pieces of ``capacity`` tokens and one rest.
2. Only the histogram of the rests (in units of ``grain`` tokens, at most capacity / grain bars) comes to the driver. A linear program over
   patterns (how many rests of each length share a sequence) is solved by column generation: a revised simplex step, then an unbounded
   knapsack by dynamic programming finds the pattern of least reduced cost, until none is left or the proven gap is small.
3. Pattern counts are rounded down, then up where the rests last; what is left is packed largest first, on the histogram too.
4. Rests are ranked inside their length by running totals (no length is gathered in a task) and rank and plan give each its sequence.
"""

from __future__ import annotations

import re as _re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seatwise.llm.common import batches_of, running, written

#: How the tokenizer cuts a text into parts before it merges inside each (fixed value of the vocabulary file).
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PLAIN = _re.compile(rb"[a-z]+")
#: ASCII letters, then signs other than the apostrophe and what may join them beyond ASCII: two parts.
PUNCTUATED = _re.compile(rb"([a-z]+)([!-&(-/:-@\[-`{-~]+)")
SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """By byte value the printable letter that stands for it in byte-level vocabularies: itself, or the next code point from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class WordIds:
    """Ids of white-space separated words, each worked out once and kept; beyond ``most`` words the later half goes, as frequent words come
    early. Added tokens are matched in the text as it stands, before anything else; they are kept behind a blank, which no word holds."""

    def __init__(self, path: str, most: int = 150_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.most = self.tokenizer.model, most
        self.added = {token.content.encode(): i for i, token in self.tokenizer.get_added_tokens_decoder().items()}
        self.cuts = _re.compile(b"(" + b"|".join([_re.escape(a) for a in sorted(self.added, key=len, reverse=True)]) + b")")
        self.clear()

    def clear(self) -> None:
        self.places: dict[bytes, int] = {}
        self.flat, self.starts = array("I"), array("I", [0])
        for content, i in self.added.items():
            self.keep(b" " + content, [i])

    def forget(self) -> None:
        """Keeps the first half of the words; places are numbered in the order in which words were met."""
        half = self.most // 2
        self.places = {word: at for word, at in self.places.items() if at < half}
        self.starts = self.starts[:half + 1]
        self.flat = self.flat[:self.starts[-1]]

    def words(self, text: bytes) -> list[bytes]:
        if not any([content in text for content in self.added]):
            return text.lower().split()
        parts = self.cuts.split(text)
        return [word for n, part in enumerate(parts) for word in ([b" " + part] if n % 2 else part.lower().split())]

    def merged(self, part: bytes) -> list[int]:
        shown = part.decode("latin-1").translate(byte_letters())
        return [token.id for token in self.model.tokenize(shown)]

    def normal(self, word: bytes) -> str:
        return "".join([c.lower() for c in unicodedata.normalize("NFC", word.decode())])

    def known(self, word: bytes) -> list[int]:
        at = self.places.get(word)
        at = self.place(word) if at is None else at
        return self.flat[self.starts[at]:self.starts[at + 1]].tolist()

    def encode(self, word: bytes) -> list[int]:
        if PLAIN.fullmatch(word):
            return [token.id for token in self.model.tokenize(word.decode())]
        split = PUNCTUATED.fullmatch(word)
        if split:
            return self.known(split[1]) + self.known(split[2])
        stem = word.rstrip(SIGNS)
        if len(stem) < len(word) and self.normal(stem).isalpha():  # letters beyond ASCII, then signs: two parts as well
            return self.known(stem) + self.known(word[len(stem):])
        text = self.normal(word)
        if text.isalpha():
            return self.merged(text.encode())
        parts = [part.encode() for part in PARTS.findall(text)]
        if len(parts) == 1:
            return self.merged(parts[0])
        # a part in ASCII is itself when it is read again; others, already in lower case, might be put in another order
        return [i for part in parts for i in (self.known(part) if part.isascii() else self.merged(part))]

    def place(self, word: bytes) -> int:
        return self.keep(word, self.encode(word))

    def keep(self, word: bytes, ids: list[int]) -> int:
        at = self.places[word] = len(self.starts) - 1
        self.flat.extend(ids)
        self.starts.append(len(self.flat))
        return at

    def batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text starts."""
        if len(self.places) > self.most:
            self.forget()
        places, firsts = [], [0]
        for text in texts:
            words = self.words(text)
            found = list(map(self.places.get, words))
            if None in found:
                for i in [i for i, at in enumerate(found) if at is None]:
                    at = self.places.get(words[i])
                    found[i] = self.place(words[i]) if at is None else at
            places += found
            firsts.append(len(places))
        at = np.array(places, np.int64)
        flat, starts = np.array(self.flat, np.uint32), np.array(self.starts, np.int64)
        sizes = starts[at + 1] - starts[at]
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
        return flat[np.repeat(starts[at] - ends[:-1], sizes) + np.arange(ends[-1])], ends[firsts]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The store of a Python worker: the tasks it runs one after another share it."""
    return WordIds(path)


def pieces(docs: DataFrame, doc_id: str, text: str, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer)
        end = np.array([end_id], np.uint32)
        for whole in batches:
            for batch in batches_of(whole, "text"):
                of, start, length, crc, tokens = [], [], [], [], []
                flat, bounds = ids_of.batch([x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()])
                for row in range(len(batch)):
                    ids = np.concatenate((flat[bounds[row]:bounds[row + 1]], end)).astype("<u4")
                    for first in range(0, len(ids), capacity):
                        part = ids[first:first + capacity]
                        of.append(row)
                        start.append(first)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        tokens.append(len(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(of, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return rows.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(prices: np.ndarray, units: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of highest total price: an unbounded knapsack by dynamic programming over the room used."""
    value, choice = np.zeros(room + 1), np.full(room + 1, -1)
    offer = np.full(room + 1, -1.0)
    offer[units] = prices  # by length, so that the rooms left are one reversed slice
    place = np.zeros(room + 1, np.int64)
    place[units] = np.arange(len(units))
    for used in range(1, room + 1):
        offers = offer[1:used + 1] + value[used - 1::-1] if used > 1 else offer[1:2]
        top = int(offers.argmax())
        if offers[top] > value[used - 1] + 1e-12:
            value[used], choice[used] = offers[top], place[top + 1]
        else:
            value[used] = value[used - 1]
    pattern, used = np.zeros(len(units), np.int64), room
    while used > 0:
        if choice[used] < 0:
            used -= 1
        else:
            pattern[choice[used]] += 1
            used -= units[choice[used]]
    return float(value[room]), pattern


def solve(units: np.ndarray, demand: np.ndarray, room: int, gap: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and their fractional counts that cover ``demand`` with nearly the fewest sequences."""
    patterns = np.diag(room // units)
    cost = np.ones(len(units))
    inverse = np.diag(1 / (room // units).astype(float))
    amounts = inverse @ demand
    centre, least, pull = units / room, float(demand @ units) / room, 0.8
    while cost @ amounts > least * (1 + gap):
        prices = cost @ inverse
        surplus = int(np.argmin(prices))
        if prices[surplus] < -1e-9:  # covering more of this length than asked for would pay
            entering = np.zeros(len(units), np.int64)
            entering[surplus] = -1
        else:
            asked = pull * centre + (1 - pull) * np.maximum(prices, 0)  # smoothed, as the plain prices swing from step to step
            worth, entering = best_pattern(asked, units, room)
            bound = float(asked @ demand) / worth  # Farley: asked / worth is feasible in the dual, so no plan needs less
            if bound > least:
                centre, least = asked / worth, bound
            if entering @ prices <= 1 + 1e-9:
                if pull == 0:
                    break
                pull = pull - 0.2 if pull > 0.25 else 0.0
                continue
            pull = 0.8
        step = inverse @ entering
        ratios = np.where(step > 1e-9, amounts / np.where(step > 1e-9, step, 1), np.inf)
        leaving = int(np.argmin(ratios))
        row = inverse[leaving] / step[leaving]
        inverse -= np.outer(step, row)
        inverse[leaving] = row
        theta = max(ratios[leaving], 0.0)
        amounts = np.maximum(amounts - theta * step, 0)
        amounts[leaving] = theta
        cost[leaving] = float(entering.min() >= 0)
        patterns[leaving] = entering
    return patterns[cost > 0], amounts[cost > 0]


class Plan(NamedTuple):
    """For every unit length, in order: from which rank on a pattern's slots follow, their first sequence and how many a sequence has."""
    units: np.ndarray
    ranks: np.ndarray
    sequences: np.ndarray
    per: np.ndarray
    total: int


def plan(counts: dict[int, int], room: int) -> Plan:
    """Which sequence takes the rests of each length, by rank. Depends on the histogram alone."""
    units = np.array(sorted(counts), np.int64)
    left = np.array([counts[u] for u in units], np.int64)
    uses: list[tuple[np.ndarray, int]] = []

    def use(pattern: np.ndarray, times: int) -> None:
        if times > 0:
            uses.append((pattern, times))
            np.subtract(left, pattern * times, out=left)

    if len(units):
        patterns, amounts = solve(units, left.astype(float), room)
        whole = np.floor(amounts + 1e-9).astype(np.int64)
        for i in range(len(patterns)):
            held = patterns[i] > 0
            use(patterns[i], int(min(whole[i], (left[held] // patterns[i][held]).min())))
        for i in np.argsort(whole - amounts, kind="stable"):
            held = patterns[i] > 0
            if (left[held] >= patterns[i][held]).all():
                use(patterns[i], 1)
        while left.any():  # largest first
            pattern, space = np.zeros(len(units), np.int64), room
            for i in range(len(units) - 1, -1, -1):
                pattern[i] = min(left[i], space // units[i])
                space -= pattern[i] * units[i]
            held = pattern > 0
            use(pattern, int((left[held] // pattern[held]).min()))
    rows, sequence, used = [], 0, np.zeros(len(units), np.int64)
    for pattern, times in uses:
        for i in np.flatnonzero(pattern):
            rows.append((units[i], used[i], sequence, pattern[i]))
        used += pattern * times
        sequence += times
    rows = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Plan(rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3], sequence)


def assigned(ranked: DataFrame, kind: str, made: Plan) -> DataFrame:
    """Adds sequence_id by length and rank; the plan has a few rows for each unit length."""
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "units"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, rank = batch.column("units").to_numpy(), batch.column("rank").to_numpy()
            first = np.searchsorted(made.units, units, "left")
            at = np.empty(len(units), np.int64)
            for unit in np.unique(units):
                own = np.flatnonzero(units == unit)
                lo = first[own[0]]
                hi = np.searchsorted(made.units, unit, "right")
                at[own] = lo + np.searchsorted(made.ranks[lo:hi], rank[own], "right") - 1
            sequence = made.sequences[at] + (rank - made.ranks[at]) // made.per[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence)], [*columns, "sequence_id"])

    return ranked.select(*columns, "rank").mapInArrow(
        place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, units long, sequence_id long")


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 1,
         grain: int = 8) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset (gapless from 0 in its sequence).

    Null and empty texts are the end id alone, one token. Very long texts become many full sequences and a rest. Repeated rows are
    documents of their own; rows that are equal in every column may change places. A null doc_id is packed like any other. An empty
    table gives no sequences. Other columns are ignored. ``capacity`` must be a multiple of ``grain``.
    """
    cut = written(pieces(docs, doc_id, text, tokenizer, capacity, end_id)
                  .withColumn("units", F.ceil(F.col("length") / grain).cast("long")), "pieces")
    counts = {r["units"]: r["n"] for r in cut.groupBy("units").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity / grain rows
    made = plan(counts, capacity // grain)
    kind = cut.schema["doc_id"].dataType.simpleString()
    ranked = running(cut.withColumn("one", F.lit(1).cast("long")), ["units"], {"rank": "one"},
                     ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("units"), "doc_id", "start", "ids_crc32", "length", "doc_tokens")
    offset = F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset")
    return assigned(ranked, kind, made).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset)
