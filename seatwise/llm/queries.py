"""The queries of this subpackage: each applies one operator to its whole table and returns its full result."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seatwise.llm import golay, imatch, licenses, minhash_join, mixing, multi_index, packing, quality, setm, sharding, term_pipeline, warc, wrappers
from seatwise.llm.common import shared_folder, table, written

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"))


def op4_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.resolve(written(warc.read_headers(spark, path), "headers"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op11_term_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_pipeline.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_setm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setm.collocations(table(spark, sf_dir, "documents"))


def op13_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {query.__name__: query for query in (
    op1_wrappers, op2_sharding, op3_multi_index, op4_minhash_join, op5_imatch, op6_warc, op7_quality,
    op8_packing, op9_mixing, op10_licenses, op11_term_pipeline, op12_setm, op13_golay_simhash)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op11_term_pipeline": f"""
WITH docs AS (SELECT row_number() OVER () AS doc, doc_id, {_TERMS} AS t FROM documents),
items AS (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS t FROM benchmark),
asked AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(t) AS term FROM items) GROUP BY ALL),
totals AS (SELECT count(*) FILTER (len(t) > 0) AS n, sum(len(t))::BIGINT AS l FROM docs),
lengths AS (SELECT doc, doc_id, 75 + (25 * len(t) * n) // l AS m FROM docs, totals WHERE len(t) > 0),
tfs AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(t) AS term FROM docs) SEMI JOIN asked USING (term) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, totals GROUP BY term),
scores AS (SELECT item, item_id, doc, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (doc) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank
    FROM scores WHERE score > 0) WHERE rank <= 20
""",
    "op12_setm": rf"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
pieces AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM texts),
words AS (SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM pieces),
runs AS (SELECT lang, w1, lead(w1) OVER (PARTITION BY piece ORDER BY i) AS w2, lead(w1, 2) OVER (PARTITION BY piece ORDER BY i) AS w3 FROM words),
counts AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, [w1] AS p FROM runs UNION ALL SELECT lang, [w1, w2] FROM runs WHERE w2 IS NOT NULL
    UNION ALL SELECT lang, [w1, w2, w3] FROM runs WHERE w3 IS NOT NULL) GROUP BY lang, p),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE len(p) = 1 GROUP BY lang),
candidates AS (SELECT * FROM counts WHERE len(p) > 1 AND f >= 10),
halves AS (SELECT lang, p, f AS a, k, p[1:k] AS head, p[k + 1:len(p)] AS tail FROM candidates, (VALUES (1), (2)) cut(k) WHERE k < len(p)),
cuts AS (SELECT h.lang, h.p, a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
    FROM halves h JOIN counts x ON x.lang = h.lang AND x.p = h.head JOIN counts y ON y.lang = h.lang AND y.p = h.tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_pairs AS (SELECT lang, p[i:i + 1] AS p, max(f) AS longer FROM candidates, (VALUES (1), (2)) place(i) WHERE len(p) = 3 GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_pairs USING (lang, p) WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, array_to_string(p, ' ') AS phrase,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""",
}
