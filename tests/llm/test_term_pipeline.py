"""Ranked search against a plain sum over all documents, and against its SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from seatwise.llm import term_pipeline
from seatwise.llm.common import table
from seatwise.llm.queries import ORACLES, op11_term_pipeline
from tests.llm.conftest import SF
from tests.llm.test_documents import lower

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, most=20):
    """Rows of (item_id, rank, doc_id, score); ``docs`` and ``items`` are pairs of id and text."""
    held = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    n, size = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(term for _, c in held for term in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c in held:
            m = 75 + 25 * c.total() * n // size if size else 0
            total = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
                        for t in TERM.findall(lower(text)) if c[t])
            if total > 0:
                scores.append((-total, doc_id is None, doc_id))
        out += [(item_id, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:most], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_equals_a_plain_sum_and_its_sql(spark):
    docs, items = (table(spark, SF, name) for name in ("documents", "benchmark"))
    got = rows_of(op11_term_pipeline(spark, SF))
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    views = " ".join(f"CREATE TEMP VIEW {name} AS FROM '{SF}/{name}.parquet';" for name in ("documents", "benchmark"))
    con = duckdb.connect()
    con.execute(views)
    assert got == sorted(con.sql(f"SELECT item_id, rank, doc_id, score FROM ({ORACLES['op11_term_pipeline']})").fetchall(), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_pruning_drops_no_answer(spark, seed):
    """Rare and common terms, many ties, blocks of 16 documents and bundles of 4 items."""
    draw = random.Random(seed)
    words = [f"w{int(draw.paretovariate(0.4)) % 400}" for _ in range(30_000)]
    docs = [(i, " ".join(draw.choices(words, k=draw.randrange(0, 60)))) for i in range(500)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(None, docs[7][1]), (None, docs[9][1])]
    items = [(i, " ".join(draw.choices(words, k=draw.randrange(1, 25)))) for i in range(14)] + [(99, docs[7][1]), (99, docs[7][1])]
    got = term_pipeline.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most=5,
                               owners=(16, 4) if seed else (3,), block_bits=4, bundle_bits=2)
    assert rows_of(got) == plain(docs, items, 5)


def test_awkward_rows(spark, documents, nothing):
    items = spark.createDataFrame([(0, "THE quick fox, version 2.0"), (1, None), (2, " ..."), (3, "same row"), (None, "w29999 w0 é"), (4, "absent")],
                                  "item_id long, text string").selectExpr("*", "'x' AS doc_id", "'y' AS term", "'z' AS bundle")
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    got = rows_of(term_pipeline.search(documents, items))
    assert got == plain(docs, [(r.item_id, r.text) for r in items.collect()])
    assert [r for r in got if r[0] == 3][0][2] == [r for r in got if r[0] == 3][1][2] == 11
    assert term_pipeline.search(nothing, items).count() == 0
    assert term_pipeline.search(documents, items.limit(0)).count() == 0
