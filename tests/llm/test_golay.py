"""Golay-code SimHash against brute force over all pairs."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from seatwise.llm import golay
from seatwise.llm.common import table
from tests.llm.conftest import SF
from tests.llm.test_documents import WORD, lower


def fingerprint(text):
    words = WORD.findall(lower(text))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(words):
    """The least word reachable by steps of at most two bits, over all pairs."""
    root = {w: w for w in words}

    def find(w):
        while root[w] != w:
            w = root[w]
        return w

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {w: find(w) for w in root}


def test_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    marks = {r.doc_id: fingerprint(r.text) for r in docs.collect()}
    groups = linked(set(marks.values()))
    least = {}
    for doc_id, mark in sorted(marks.items()):
        least.setdefault(groups[mark], doc_id)
    got = golay.near_duplicates(docs).collect()
    assert len(got) == len(marks)
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{marks[r.doc_id]:016x}", least[groups[marks[r.doc_id]]])


@pytest.mark.parametrize("list_size", [1, 3, 1000])
def test_links_join_what_brute_force_joins(spark, list_size):
    """Families of words a few bits apart, in short lists (pairs) and in long ones (words one bit away)."""
    draw, words = random.Random(list_size), set()
    for _ in range(40):
        centre = draw.getrandbits(64)
        words |= {centre, centre ^ (1 << 63)}
        words |= {centre ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(1, 5))) for _ in range(draw.randrange(1, 60))}
    words |= {0, 3, 1 << 63, (1 << 64) - 1}
    signed = {w: w - (1 << 64) if w >> 63 else w for w in words}
    nodes = spark.createDataFrame([(s,) for s in signed.values()], "node long")
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in golay.links(nodes, list_size).collect()]
    assert all((a ^ b).bit_count() in (1, 2) for a, b in found)
    root = {w: w for w in words}

    def find(w):
        while root[w] != w:
            w = root[w]
        return w

    for a, b in found:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {w: find(w) for w in words} == linked(words)


def test_words_two_bits_apart_share_a_codeword():
    draw = np.random.default_rng(1)
    words = draw.integers(0, 1 << 23, 2000)
    numbers, counts = golay.codeword_numbers(words)
    assert set(counts.tolist()) == {1, 6}
    mine = [set(row[:n].tolist()) for row, n in zip(numbers, counts, strict=True)]
    for a, b in combinations(range(23), 2):
        other, n = golay.codeword_numbers(words[:50] ^ (1 << a) ^ (1 << b))
        assert all(mine[i] & set(other[i][:n[i]].tolist()) for i in range(50))


def test_hashes_equal_the_library_on_odd_texts():
    texts = ["", None, "One", "one  TWO", "a b c", "É à ü x y", "x" * 100 + " y " + "z" * 50 + "\v\f\r\n q", " lead and trail "]
    hashes, firsts = golay.shingle_hashes(pa.array(texts))
    marks = golay.majority(hashes, firsts)
    assert [int(m) for m in marks] == [fingerprint(t) for t in texts]


def test_awkward_rows(documents, nothing):
    got = golay.near_duplicates(documents).collect()
    assert len(got) == documents.count()
    by = {r.doc_id: r for r in got}
    assert by[1].component_id == by[2].component_id == 1
    assert {by[i].fingerprint for i in (4, 5, 10)} == {"0" * 16} and {by[i].component_id for i in (4, 5, 10)} == {4}
    assert by[7].fingerprint == by[8].fingerprint == by[9].fingerprint and by[9].component_id == 7
    assert by[None].component_id is None and sum(r.doc_id == 11 for r in got) == 2
    assert golay.near_duplicates(nothing).count() == 0
