"""Readers see one version; repeated batches and late writers change nothing."""

import tempfile
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest

from seatwise.operators import special
from seatwise.sources.versions import Conflict, publish, read_version, versions


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="seatwise-versions-") + "/table"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_reader_keeps_its_version(spark, root):
    with pytest.raises(FileNotFoundError):
        read_version(spark, root)
    assert publish(spark.createDataFrame([(1, "a")], "id long, t string"), root, "b1") == 1
    reader = read_version(spark, root)
    assert publish(spark.createDataFrame([(2, "b"), (3, "c")], "id long, t string"), root, "b2", made_from=1) == 2
    assert rows_of(reader) == [(1, "a")] and rows_of(read_version(spark, root)) == [(2, "b"), (3, "c")]
    assert rows_of(read_version(spark, root, 1)) == [(1, "a")]


def test_a_repeated_batch_and_a_late_writer_change_nothing(spark, root):
    one = spark.range(3)
    assert publish(one, root, "b1", made_from=0) == publish(spark.range(9), root, "b1", made_from=0) == 1
    publish(spark.range(5), root, "b2", made_from=1)
    with pytest.raises(Conflict):
        publish(spark.range(7), root, "b3", made_from=1)
    assert read_version(spark, root).count() == 5 and [v.batch for v in versions(spark, root)] == ["b1", "b2"]


def test_unfinished_folders_are_never_read(spark, root):
    publish(spark.range(3), root, "b1")
    spark.range(50).write.parquet(f"{root}/data/left-by-a-dead-job")
    Path(root, "manifests", "000000000002.json.x.tmp").write_text("{")
    assert read_version(spark, root).count() == 3 and publish(spark.range(4), root, "b2") == 2


def test_writers_at_once_take_turns_or_are_told(spark, root):
    publish(spark.range(1), root, "first")
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda i: publish(spark.range(i), root, f"b{i}"), range(2, 8)))
    assert sorted(done) == list(range(2, 8)) and len(versions(spark, root)) == 7


def test_insert_if_absent_as_a_published_table(spark, root):
    kinds = "venue_id long, kind string, title string"
    publish(spark.createDataFrame([(1, "gala", "Old")], kinds), root, "seed")
    new = spark.createDataFrame([(1, "gala", "New"), (2, "gala", "Two")], kinds)
    for _ in range(2):  # the job runs twice
        at = versions(spark, root)[-1].number
        publish(special.insert_if_absent(read_version(spark, root, at), new, ["venue_id", "kind"], "title"), root, "2026-10-15", made_from=at)
    assert rows_of(read_version(spark, root)) == [(1, "gala", "Old"), (2, "gala", "Two")] and len(versions(spark, root)) == 2
