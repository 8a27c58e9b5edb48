import random

from pyspark.sql import functions as F

from seatwise.operators import windows as w


def test_rolling_counts_with_a_hot_key(spark):
    rng = random.Random(5)
    events = [(1, rng.randint(0, 5000)) for _ in range(900)] + [(2, rng.randint(0, 5000)) for _ in range(60)]
    points = [(rng.choice([1, 2, 3]), rng.randint(0, 5200)) for _ in range(200)]
    ev = spark.createDataFrame(events, "k long, epoch long")
    pt = spark.createDataFrame(points, "k long, epoch long")
    got = {(r.k, r.epoch): r.n for r in w.with_rolling_count(pt, ev, ["k"], 600, "n").collect()}
    assert got == {(k, e): sum(k == a and e - 600 < x <= e for a, x in events) for k, e in points}
    ids = ev.withColumn("id", F.col("epoch") * 10)
    latest = {(r.k, r.epoch): r.last for r in w.with_rolling_latest(pt, ids, ["k"], 600, "id", "last").collect()}
    assert latest == {(k, e): max((x * 10 for a, x in events if a == k and e - 600 < x <= e), default=None) for k, e in points}


def test_ranked_by_id_matches_row_number(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), i) for i in rng.sample(range(100_000), 500)]
    got = {r.id: r.rank for r in w.ranked_by_id(spark.createDataFrame(rows, "k string, id long"), ["k"], "id", "rank", block=1000).collect()}
    for key in "ab":
        for rank, i in enumerate(sorted(i for k, i in rows if k == key), 1):
            assert got[i] == rank


def test_upper_median(spark):
    rng = random.Random(7)
    rows = [("a", float(v)) for v in (1, 2, 3, 4)] + [("b", 1.5)] + [("c", rng.random() * 50) for _ in range(301)]
    got = {r.k: r.m for r in w.upper_median(spark.createDataFrame(rows, "k string, v double"), "v", ["k"], "m").collect()}
    for key in "abc":
        values = sorted(v for k, v in rows if k == key)
        assert got[key] == values[len(values) // 2]


def test_trailing_rows(spark):
    rows = [(1, i) for i in range(30)] + [(2, 100)]
    got = w.trailing_rows(spark.createDataFrame(rows, "s long, id long"), ["s"], [F.col("id").desc()], 20).collect()
    assert sorted((r.s, r.id) for r in got) == [(1, i) for i in range(10, 30)] + [(2, 100)]


def test_counts_sort_a_bucket_once_over_all_partitions(spark):
    events = spark.createDataFrame([(1, e) for e in (0, 5, 9, 10, 19, 20)], "k long, epoch long")
    counts = w.rolling_counts(events, events, ["k"], 10, "n")
    assert {r.epoch: r.n for r in counts.collect()} == {0: 1, 5: 2, 9: 3, 10: 3, 19: 2, 20: 2}
    plan = counts._jdf.queryExecution().sparkPlan().toString()
    sorts = {line.split("Window [")[1].split("], [")[-1] for line in plan.splitlines() if "Window [" in line}
    assert len(sorts) == 1
    full = counts._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in full
