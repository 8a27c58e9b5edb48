"""SETM phrase mining against a plain count of all phrases, and against its SQL."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from seatwise.llm import setm
from seatwise.llm.common import table
from seatwise.llm.queries import ORACLES, op12_setm
from tests.llm.conftest import SF
from tests.llm.test_documents import lower


def plain(rows, longest=3, least=10, percent=50, most=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang or "und", tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, p), a in candidates.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                longer[lang, p[i:i + size]] = max(longer[lang, p[i:i + size]], a)
    out = {}
    for (lang, p), a in candidates.items():
        if 100 * longer[lang, p] >= percent * a:
            continue
        cuts = [(1000000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, totals[lang], -score)
            for lang, found in out.items() for i, (score, a, p, left, right) in enumerate(sorted(found)[:most])}


def rows_of(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def test_equals_a_plain_count(spark):
    docs = table(spark, SF, "documents")
    got = rows_of(setm.collocations(docs))
    assert got == plain([(r.lang, r.text) for r in docs.collect()]) and got


def test_equals_its_sql(spark):
    want = {tuple(r) for r in duckdb.sql(f"WITH documents AS (FROM '{SF}/documents.parquet') SELECT lang, rank, phrase, a, l, r, n, score FROM ({ORACLES['op12_setm']})").fetchall()}
    assert rows_of(op12_setm(spark, SF)) == want


@pytest.mark.parametrize(("longest", "least", "most"), [(2, 1, 5), (3, 2, 2000), (4, 2, 2000), (5, 1, 40)])
def test_other_lengths_and_bounds(spark, longest, least, most):
    draw = np.random.default_rng(longest)
    rows = [(("en", "de", None, "und")[i % 4], "".join(str(draw.choice(["a", "B", "b", "cé", "dd"])) + str(draw.choice([" ", "\t ", " ", ". ", "\n"]))
                                                       for _ in range(60))) for i in range(24)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert rows_of(setm.collocations(docs, longest=longest, least=least, most=most)) == plain(rows, longest, least, 50, most)


def test_blocks_are_cut_without_changing_anything(spark):
    docs = table(spark, SF, "documents")
    want = rows_of(setm.collocations(docs))
    assert rows_of(setm.collocations(docs.repartition(7))) == want


def test_scores_beyond_64_bits(spark):
    a, left, right = 3_000_000_019, 4_000_000_007, 5_000_000_029
    got = spark.createDataFrame([(a, left, right)], "a long, l long, r long").selectExpr(f"{setm.SCORE} AS s").first().s
    assert got == 1000000 * a * a // (left * right)


def test_awkward_rows(documents, nothing):
    many = documents
    for _ in range(4):
        many = many.unionByName(many)
    got = rows_of(setm.collocations(many))
    want = plain([(r.lang, r.text) for r in documents.collect()] * 16)
    assert got == want and len(got) > 1000
    assert setm.collocations(nothing).count() == 0
    assert setm.collocations(documents.where("text IS NULL OR trim(text) = ''")).count() == 0
