"""The pipeline against its operators applied one after another by hand, and the registered names."""

import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline
from seatwise.llm import minhash_join, mixing, quality
from seatwise.llm.common import batches_of, table
from tests.llm.conftest import SF


def test_every_operator_and_the_pipeline_are_registered():
    names = entry_module.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14)) and "pipeline" in names


def test_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, SF, "documents")
    (_, good), (_, one), (_, mixed), _ = corpus_pipeline.STAGES
    scores = {r.doc_id: r.predicted for r in quality.score_documents(docs, table(spark, SF, "labels")).collect()}
    first = corpus_pipeline.written(good(spark, docs, SF), "t")
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == {d for d, p in scores.items() if p}
    second = corpus_pipeline.written(one(spark, first, SF), "t")
    kept = {r.doc_id for r in minhash_join.near_duplicates(first).collect() if r.kept}
    assert second.columns == docs.columns and Counter(r.doc_id for r in second.collect()) == Counter(kept)
    third = mixed(spark, second, SF)
    taken = {r.doc_id: -(-r.taken // r["size"]) for r in mixing.mix(second).collect() if r.taken}
    assert third.columns == docs.columns and Counter(r.doc_id for r in third.collect()) == Counter(taken)
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert Counter(p.doc_id for p in pieces if p.start == 0) == Counter(taken)


def test_near_dedup_shuffles_whole_texts_once(spark):
    docs = table(spark, SF, "documents")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = minhash_join.one_of_each(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    above, join = plan.split("SortMergeJoin", 1)
    assert "Exchange" not in above and "LeftSemi" in join.split("\n")[0]


def test_words_are_counted_without_an_array_of_them(spark):
    texts = [None, "", " ", "\n\t x", "x ", "a b  c", "\U0001f600   z\x0bq\x0c\r", " w w ", "\x00 \x1f", "\x85a\u2003b c", "$1 \\ a", "b" * 100_000 + " b"]
    counted = spark.createDataFrame([(t,) for t in texts], "text string").select("text", mixing.word_count(F.col("text")).alias("n"))
    assert [r.n for r in counted.collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert "extract_all" not in counted._jdf.queryExecution().executedPlan().toString()


def test_scoring_holds_few_arrays_at_once():
    whole = pa.RecordBatch.from_pydict({"text": [" ".join(f"w{i * j % 9973}" for j in range(300)) for i in range(2500)]})
    vectors, counts = np.ones((quality.BUCKETS, quality.DIM), np.float32), np.zeros(quality.BUCKETS * quality.DIM)
    quality.words_of(whole.column("text").slice(0, 1))  # the powers are made once
    tracemalloc.start()
    for batch in batches_of(whole, "text", quality.BATCH):
        words = quality.words_of(batch.column("text"))
        quality.add_contexts(counts, words)
        quality.pooled(words, vectors)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert whole.nbytes > 4_000_000 and held < 60_000_000
