"""License detection by ordered signature rules. DataFrame functions only; one pass, no shuffle.

A text that may name a license (one cheap pattern says) is reduced to its words. Of the rules, families of names times ways of naming
them, only those whose keyword the text contains are tried. Each match is a detection: a stretch of words with the rule's priority.
A detection inside a longer one, or on the same stretch as one of better priority, is suppressed.

The base phrases are counted apart: places where a phrase's words stand next to each other. Their labels always stay.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatwise.llm.common import once

#: The base phrases and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: Label, keyword that a text must contain, pattern of the name over lower-case words with one space between.
FAMILIES = [
    ("agpl-1.0", " affero ", r"affero (?:gnu )?general public licen[sc]e (?:version |v)?1"),
    ("agpl-3.0", " affero ", r"(?:gnu )?affero general public licen[sc]e(?: (?:version |v)?3(?: 0)?)?"),
    ("apache-1.1", " apache ", r"apache (?:software )?licen[sc]e (?:version |v)?1 1"),
    ("apache-2.0", " apache ", r"apache (?:software )?licen[sc]e (?:version |v)?2(?: 0)?"),
    ("artistic", " artistic ", r"artistic licen[sc]e(?: (?:version |v)?2 0)?"),
    ("boost-1.0", " boost ", r"boost software licen[sc]e(?: (?:version |v)?1 0)?"),
    ("bsd-2-clause", " bsd ", r"(?:simplified|freebsd|2 clause) bsd licen[sc]e|bsd 2 clause(?: licen[sc]e)?"),
    ("bsd-3-clause", " bsd ", r"(?:new|revised|modified|3 clause) bsd licen[sc]e|bsd 3 clause(?: licen[sc]e)?"),
    ("bsd", " bsd ", r"bsd (?:style )?licen[sc]e"),
    ("cc0", " cc0 ", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc", " cc by nc ", r"cc by nc(?: \d 0)?"),
    ("cc-by-nc-nd", " cc by nc nd ", r"cc by nc nd(?: \d 0)?"),
    ("cc-by-nc-sa", " cc by nc sa ", r"cc by nc sa(?: \d 0)?"),
    ("cc-by-nd", " cc by nd ", r"cc by nd(?: \d 0)?"),
    ("cc-by-sa", " cc by sa ", r"cc by sa(?: \d 0)?"),
    ("cc-by-4.0", " cc by 4 0 ", r"cc by 4 0"),
    ("cc-by-attribution", " creative commons ", r"creative commons attribution(?: \d 0)?(?: (?:international|unported|generic))?(?: licen[sc]e)?"),
    ("cc-by-sa-attribution", " creative commons ", r"creative commons attribution share ?alike(?: \d 0)?(?: (?:international|unported))?(?: licen[sc]e)?"),
    ("cc-by-nc-attribution", " creative commons ", r"creative commons attribution non ?commercial(?: \d 0)?(?: (?:international|unported))?(?: licen[sc]e)?"),
    ("cddl", " cddl ", r"cddl(?: (?:version |v)?1 [01])?"),
    ("cddl", " common development ", r"common development and distribution licen[sc]e"),
    ("cpl", " common public ", r"common public licen[sc]e"),
    ("epl-1.0", " eclipse ", r"eclipse public licen[sc]e (?:version |v)?1(?: 0)?"),
    ("epl-2.0", " eclipse ", r"eclipse public licen[sc]e (?:version |v)?2(?: 0)?"),
    ("epl", " eclipse ", r"eclipse public licen[sc]e"),
    ("eupl", " european union ", r"european union public licen[sc]e(?: (?:version |v)?1 [0-2])?"),
    ("gfdl", " documentation ", r"(?:gnu )?free documentation licen[sc]e(?: (?:version |v)?1 [1-3])?"),
    ("gpl-2.0", " gnu ", r"gnu (?:general public licen[sc]e|gpl) (?:version |v)?2(?: 0)?"),
    ("gpl-3.0", " gnu ", r"gnu (?:general public licen[sc]e|gpl) (?:version |v)?3(?: 0)?"),
    ("gpl-2.0", " gpl ", r"gpl (?:version |v)?2(?: 0)?"),
    ("gpl-3.0", " gpl ", r"gpl (?:version |v)?3(?: 0)?"),
    ("isc", " isc ", r"isc licen[sc]e"),
    ("lgpl-2.1", " lesser ", r"(?:gnu )?lesser general public licen[sc]e (?:version |v)?2 1"),
    ("lgpl-3.0", " lesser ", r"(?:gnu )?lesser general public licen[sc]e (?:version |v)?3(?: 0)?"),
    ("lgpl", " lesser ", r"(?:gnu )?lesser general public licen[sc]e"),
    ("lgpl-2.0", " library ", r"(?:gnu )?library general public licen[sc]e"),
    ("mit-x11", " x11 ", r"(?:mit )?x11 licen[sc]e"),
    ("mpl-1.1", " mozilla ", r"mozilla public licen[sc]e (?:version |v)?1(?: [01])?"),
    ("mpl-2.0", " mozilla ", r"mozilla public licen[sc]e (?:version |v)?2(?: 0)?"),
    ("ms-pl", " microsoft ", r"microsoft public licen[sc]e"),
    ("odbl", " database ", r"open (?:data commons )?database licen[sc]e"),
    ("ofl-1.1", " open font ", r"(?:sil )?open font licen[sc]e(?: (?:version |v)?1 1)?"),
    ("proprietary", " rights reserved ", r"all rights reserved"),
    ("public-domain", " public domain ", r"public domain(?: dedication)?"),
    ("python", " python ", r"python (?:software foundation )?licen[sc]e"),
    ("unlicense", " unlicense ", r"unlicense"),
    ("wtfpl", " wtfpl ", r"wtfpl"),
    ("zlib", " zlib ", r"zlib(?: libpng)? licen[sc]e"),
]

#: Ways of naming a license, best priority first: pattern around the name, and how sure a match is.
WAYS = [
    (r"spdx licen[sc]e identifier (?:{name})", 0.99),
    (r"(?:licen[sc]ed|released|distributed|published|available|provided|redistribute it) (?:and or modify it )?(?:under|subject to|according to)"
     r"(?: the)?(?: terms(?: and conditions)? of)?(?: the)? (?:{name})", 0.95),
    (r"(?:under|subject to) (?:the )?terms(?: and conditions)? of (?:the )?(?:{name})", 0.9),
    (r"copy of (?:the )?(?:{name})", 0.85),
    (r"(?:{name})", 0.7),
]

#: Whatever a base phrase or a rule matches contains one of these in lower case, or "cc", other signs and "by".
MARKS = ("licen", "reserved", "domain", "creative", "commons", "wtfpl", "cddl", "cc0", "gpl", "bsd")


def may_match(text: Column) -> Column:
    low = F.lower(text)
    found = low.contains("cc") & low.rlike(r"cc[^0-9a-z]+by")
    for mark in MARKS:
        found = found | low.contains(mark)
    return found


def rules() -> list[dict]:
    """All rules in order: every way of naming every family (240)."""
    return [{"label": label, "keyword": keyword, "pattern": "(?<= )" + way.replace("{name}", name) + "(?= )", "priority": priority, "score": score}
            for priority, (way, score) in enumerate(WAYS) for label, keyword, name in FAMILIES]


SPAN = "array<struct<first:int,last:int,priority:int,score:double,label:string>>"


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def spans_of(rule: Column, words: Column) -> Column:
    """Where a rule matches ``words`` (a blank before, between and after words): first and last word, priority, score, label."""
    def located(hits: Column, between: Column) -> Column:
        def span(hit: Column, i: Column) -> Column:
            passed = F.aggregate(F.slice(between, F.lit(1), i + 1), F.lit(0), lambda n, part: n + spaces(part))
            passed = F.aggregate(F.slice(hits, F.lit(1), i), passed, lambda n, part: n + spaces(part)) - 1
            return F.struct(passed.alias("first"), (passed + spaces(hit)).alias("last"), rule["priority"].alias("priority"),
                            rule["score"].alias("score"), rule["label"].alias("label"))
        return F.transform(hits, span)

    hits = F.regexp_extract_all(words, rule["pattern"], F.lit(0))
    return once(hits, lambda h: F.when(F.size(h) > 0, once(F.split(words, rule["pattern"]), lambda b: located(h, b)))
                .otherwise(F.array().cast(SPAN)))


def unsuppressed(spans: Column) -> Column:
    def rank(s: Column) -> Column:
        return F.struct(s["priority"], -s["score"], s["label"])

    def beaten(s: Column) -> Column:
        def beats(o: Column) -> Column:
            covers = (o["first"] <= s["first"]) & (o["last"] >= s["last"])
            longer = (o["last"] - o["first"]) > (s["last"] - s["first"])
            return covers & (longer | (rank(o) < rank(s)))
        return F.exists(spans, beats)

    return F.filter(spans, lambda s: ~beaten(s))


def places(phrase: str, words: Column, listed: Column) -> Column:
    """The word numbers at which a phrase starts."""
    parts = phrase.split(" ")
    starts = F.sequence(F.lit(0), F.greatest(F.size(listed) - len(parts), F.lit(0)))
    here = F.filter(starts, lambda i: sum([(F.get(listed, i + k) == part).cast("int") for k, part in enumerate(parts)], F.lit(0)) == len(parts))
    return F.when(words.contains(f" {phrase} "), here).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections for every row of ``docs``.

    Null and empty texts have no words: counts 0, words null, labels empty, score 0. The score is the highest of the detections that
    stay, 0.6 for base phrases alone. Whole texts are read, however long. Repeated rows and null ids come back as they are; other
    columns are ignored. An empty table gives no rows.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lower = F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))
    rows = docs.select(F.col(doc_id).alias("doc_id"),
                       F.regexp_count(value, F.lit(r"[0-9A-Za-z\u0080-\x{10FFFF}]+")).cast("long").alias("n_words"),
                       F.when(may_match(value), words).alias("words"))
    rows = rows.withColumn("base", F.when(F.col("words").isNotNull(), once(F.split(F.trim("words"), " "), lambda listed: F.array(*[
        F.struct(F.lit(label).alias("label"), places(phrase, F.col("words"), listed).alias("at")) for phrase, label in PHRASES]))))
    tried = F.from_json(F.lit(json.dumps(rules())), "array<struct<label:string,keyword:string,pattern:string,priority:int,score:double>>")
    found = F.flatten(F.transform(F.filter(tried, lambda r: F.col("words").contains(r["keyword"])), lambda r: spans_of(r, F.col("words"))))
    rows = rows.withColumn("detections", F.coalesce(F.when(F.col("words").isNotNull(), found).cast(SPAN), F.array().cast(SPAN)))
    rows = rows.select("doc_id", "n_words", "base", unsuppressed(F.col("detections")).alias("detections"))
    at = F.coalesce(F.flatten(F.transform("base", lambda b: b["at"])), F.array().cast("array<int>"))
    base = F.coalesce(F.transform(F.filter("base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"]), F.array().cast("array<string>"))
    rows = rows.select("doc_id", "n_words", "detections", at.alias("at"), base.alias("base"))
    score = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["score"])), F.lit(0.0)),
                       F.when(F.size("at") > 0, F.lit(0.6)).otherwise(F.lit(0.0)))
    every = F.array_sort(F.array_distinct(F.concat("base", F.transform("detections", lambda d: d["label"]))))
    return rows.select("doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"),
                       F.array_max("at").cast("long").alias("last_word"), F.array_join(F.array_sort("base"), ",").alias("base_labels"),
                       F.array_join(every, ",").alias("labels"), score.alias("score"), "detections")
