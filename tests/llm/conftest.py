import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """Small documents with every awkward case: nulls, blanks, repeated rows, ties, a very long text and clashing column names."""
    long = " ".join(f"w{i}" for i in range(30_000))
    text = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    rows = [(1, text, "en", "b"), (2, text, "en", "b"), (3, text + " now", "en", "a"), (4, None, None, None), (5, "", "en", "a"),
            (6, long, "en", "b"), (7, "one two", "en", "c"), (8, "ONE two", "en", "c"), (9, "one  two", "de", None), (10, " \n\t", "en", "a"),
            (None, "no id here but five words", "en", "b"), (11, "same row", "en", "a"), (11, "same row", "en", "a"),
            (12, "Licensed under the Apache License, Version 2.0; also MIT license and CC-BY", "en", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = ("size", "shard", "key", "units", "start", "token", "node", "label", "rank", "hashes", "range", "words", "target", "taken")
    return df.selectExpr("*", "length(text) AS n_chars", *[f"'x' AS {n}" for n in names])


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
