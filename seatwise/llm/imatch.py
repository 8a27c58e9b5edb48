"""I-Match fingerprints with randomised lexicons. DataFrame functions only.

Terms are the distinct runs of letters and digits of a text, in lower case. The lexicon holds the terms whose inverse document frequency
over all distinct texts lies in a band: common words say nothing, rare ones are often typing errors. A term is in the band only if a fixed
share of the texts holds it, so the lexicon has at most (terms per text / share) entries whatever the corpus; it is kept as a
bit set of ``2 ** BITS`` bits (512 KB).

A text with too few of its terms in the lexicon (one of a large group of near copies, which make their own terms common, or one in a
rare language) is described by all of its terms, and so is whatever it is compared with.

A document's lexicon terms, distinct and sorted, are cut down to several random sub-lexicons of ever smaller shares of all terms, and what is
left in each is hashed. A small sub-lexicon is untouched by an edit that misses its few terms; which size tells most depends on the
length of the text, so there are SCALES sizes with DRAWS sub-lexicons each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatwise.llm.common import once, shuffle_partitions, written

BITS = 22
SCALES, DRAWS = 6, 8
LOW_IDF, HIGH_IDF = 2.3, 8.5


#: A text has too few terms in the lexicon if they are less than FEW or less than one in PART of all its terms.
FEW, PART = DRAWS // 2, 4


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    found = F.array_distinct(F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.xxhash64(t)))
    return F.array_remove(found, F.xxhash64(F.lit("")))


def bit_set(values: DataFrame, name: str) -> DataFrame:
    """One row: ``bits``, the bit set of the values that are ``held``, and ``n``, how many values there are. ``values``: value, held."""
    bit = F.pmod(F.col("value"), F.lit(1 << BITS))
    one = F.when(F.col("held"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")))
    longs = values.groupBy(F.floor(bit / 64).cast("int").alias("at")).agg(F.bit_or(one).alias("bits"), F.count(F.lit(1)).alias("n"))
    every = values.sparkSession.range(1 << (BITS - 6)).select(F.col("id").cast("int").alias("at"))
    longs = written(every.join(longs, "at", "left").select("at", F.coalesce("bits", F.lit(0)).alias("bits"), F.coalesce("n", F.lit(0)).alias("n")), name)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "bits"))), lambda x: x["bits"])  # 2 ** 16 longs
    return longs.agg(in_order.alias("bits"), F.sum("n").alias("n"))


def is_held(value: Column, bits: Column) -> Column:
    bit = F.pmod(value, F.lit(1 << BITS))
    return F.getbit(F.get(bits, F.floor(bit / 64).cast("int")), (bit % 64).cast("int")) == 1


def distinct_texts(rows: DataFrame) -> tuple[DataFrame, int]:
    """Every ``text`` once, and how many there are. Only texts that share their bit with a repeated one are dealt out to be compared."""
    key = F.xxhash64("text")
    found = written(bit_set(rows.groupBy(key.alias("value")).agg((F.count(F.lit(1)) > 1).alias("held")), "repeated"), "repeated")
    marked = rows.withColumn("repeated", found.select("bits").scalar()).select("text", is_held(key, F.col("repeated")).alias("repeated"))
    single, repeated = marked.where(~F.col("repeated")).select("text"), marked.where("repeated").select("text").distinct()
    return single.unionByName(repeated), found.first()["n"]


def lexicon(docs: DataFrame, text: str = "text", low: float = LOW_IDF, high: float = HIGH_IDF) -> DataFrame:
    """One row, one column: the bit set of the terms with low <= ln(distinct texts / those that hold the term) <= high."""
    rows, total = distinct_texts(docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")))
    held = rows.select(F.explode(terms(F.col("text"))).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    idf = F.log(F.lit(float(max(total, 1))) / F.col("n"))
    band = held.where((idf >= low) & (idf <= high)).select("value", F.lit(True).alias("held"))
    return bit_set(band, "lexicon").select(F.col("bits").alias("lexicon"))


def drawn_hashes(kept: Column) -> Column:
    """SCALES x DRAWS hashes of the terms in each sub-lexicon, null where it has none."""
    ordered = F.array_sort(F.transform(kept, lambda t: F.xxhash64(t, F.lit("draw"))))

    def residue(share: int, j: int):
        return lambda t: F.pmod(t, F.lit(share)) == j

    def digests(drawn: Column, share: int) -> Column:
        chosen = [F.filter(drawn, residue(share, j)) for j in range(DRAWS)]
        return F.array(*[F.when(F.size(c) > 0, F.xxhash64(c)) for c in chosen])

    def of_scale(kept: Column, scale: int) -> Column:
        share = DRAWS * 4 ** scale
        return once(F.filter(kept, lambda t: F.pmod(t, F.lit(share)) < DRAWS), lambda drawn: digests(drawn, share))

    return once(ordered, lambda k: F.flatten(F.array(*[of_scale(k, scale) for scale in range(SCALES)])))


def hashes(text: Column, known: Column) -> Column:
    """The drawn hashes of the text's lexicon terms; null if these are too few."""
    def enough(kept: Column, every: Column) -> Column:
        return (F.size(kept) >= FEW) & (F.size(kept) * PART >= F.size(every))

    def of_terms(every: Column) -> Column:
        return once(F.filter(every, lambda t: is_held(t, known)), lambda kept: F.when(enough(kept, every), drawn_hashes(kept)))

    return once(terms(text), of_terms)


def fingerprint(text: Column, found: Column) -> Column:
    """The hashes as text; a text without terms is named by its whole value."""
    some = F.exists(found, lambda h: h.isNotNull())
    shown = F.array_join(F.transform(found, lambda h: F.coalesce(F.lower(F.hex(h)), F.lit("-"))), ".")
    return F.when(some, shown).otherwise(F.concat(F.lit("text:"), F.md5(text)))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """1 for equal fingerprints, else the best share of equal sub-lexicon hashes among the sizes; a size where both texts have terms in
    fewer than half of the sub-lexicons counts as if they had that many."""
    def share(scale: int) -> Column:
        one, other = F.slice(a, scale * DRAWS + 1, DRAWS), F.slice(b, scale * DRAWS + 1, DRAWS)
        equal = F.size(F.filter(F.zip_with(one, other, lambda p, q: p == q), lambda e: F.coalesce(e, F.lit(False))))
        either = F.size(F.filter(F.zip_with(one, other, lambda p, q: F.coalesce(p, q)), lambda e: e.isNotNull()))
        return equal / F.greatest(either, F.lit(DRAWS // 2))

    return F.when(same, F.lit(1.0)).otherwise(F.greatest(*[share(s) for s in range(SCALES)]))


def with_next(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` (doc_id, text, ...) with the following row's text and hashes, by descending doc_id (nulls last), then text; after the last
    row comes the first. Rows are dealt over ranges of doc_id; the first row of each range is also put at the end of the one before it."""
    cuts = sorted({int(c) for c in rows.select(F.col("doc_id").cast("long").alias("d")).where("d is not null").approxQuantile(
        "d", [i / buckets for i in range(1, buckets)], 0.25 / buckets)})
    of = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(
        F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c > F.col("doc_id"))))
    rows = rows.withColumn("range", of.cast("int"))
    tops = {r["range"]: r["top"] for r in rows.groupBy("range").agg(F.max("doc_id").alias("top")).collect()}  # one row per range
    if not tops:
        return rows.select("*", F.col("text").alias("next_text"), F.col("hashes").alias("next_hashes"))
    ordered = sorted(tops)
    before = {here: ordered[i - 1] for i, here in enumerate(ordered)}
    first = F.col("doc_id").isin([t for t in tops.values() if t is not None])
    if None in tops.values():
        first = first | F.col("doc_id").isNull()
    heads = rows.where(first)
    heads = heads.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy(F.desc_nulls_last("doc_id"), "text"))).where("place = 1")
    moved = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("range"))
    both = rows.withColumn("end", F.lit(0)).unionByName(heads.drop("place").withColumns({"range": moved, "end": F.lit(1)}))
    after = Window.partitionBy("range").orderBy("end", F.desc_nulls_last("doc_id"), "text")
    return both.select("*", F.lead("text").over(after).alias("next_text"), F.lead("hashes").over(after).alias("next_hashes")).where("end = 0")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for every row of ``docs``.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many of the next document's (all, if it has
    fewer), by descending doc_id; null ids come last, equal ids by text, and after the last row comes the first. A null text is the
    empty text. Repeated rows follow each other. A single row follows itself. Other columns are ignored; no rows give none.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    known = written(lexicon(docs, text), "lexicon")
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), value.alias("text"))
    rows = plain.withColumn("lexicon", known.scalar()).select("doc_id", "text", hashes(F.col("text"), F.col("lexicon")).alias("hashes"))
    rows = with_next(rows, min(1024, max(16, shuffle_partitions(docs.sparkSession))))
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.left("text", n - cut), F.left("next_text", cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "text", "hashes", "next_text", "next_hashes", edited.alias("edited"))
    rows = rows.withColumn("lexicon", known.scalar()).withColumn("edited_hashes", hashes(F.col("edited"), F.col("lexicon"))).drop("lexicon")
    few, edited_few, next_few = (F.col(c).isNull() for c in ("hashes", "edited_hashes", "next_hashes"))
    rows = rows.select("*", F.when(few | edited_few | next_few, drawn_hashes(terms(F.col("text")))).alias("all"),
                       F.when(few | edited_few, drawn_hashes(terms(F.col("edited")))).alias("edited_all"),
                       F.when(few | next_few, drawn_hashes(terms(F.col("next_text")))).alias("next_all"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       F.when(few | edited_few, F.col("all")).otherwise(F.col("hashes")).alias("by_edited"),
                       F.when(few | edited_few, F.col("edited_all")).otherwise(F.col("edited_hashes")).alias("edited_hashes"),
                       F.when(few | next_few, F.col("all")).otherwise(F.col("hashes")).alias("by_next"),
                       F.when(few | next_few, F.col("next_all")).otherwise(F.col("next_hashes")).alias("next_hashes"),
                       fingerprint(F.col("text"), F.coalesce("hashes", "all")).alias("fingerprint"),
                       fingerprint(F.col("edited"), F.coalesce("edited_hashes", "edited_all")).alias("edited_fingerprint"),
                       fingerprint(F.col("next_text"), F.coalesce("next_hashes", "next_all")).alias("next_fingerprint"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness(F.col("by_edited"), F.col("edited_hashes"), F.col("fingerprint") == F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("by_next"), F.col("next_hashes"), F.col("fingerprint") == F.col("next_fingerprint")).alias("near_next"))
