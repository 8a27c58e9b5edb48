"""A question about one day reads the files of two days."""

import tempfile

import pytest

from seatwise.operators import availability as av
from seatwise.sources.booking_files import read_bookings, write_bookings
from tests import tables as t


def files_read(df):
    """Files that the scans of partitioned tables opened, from the metrics of the plan that ran."""
    df.collect()
    plan, found = [df._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            plan.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            plan.append(node.plan())
            continue
        if name.startswith("Scan parquet") and node.metrics().contains("numPartitions"):
            found.append(node.metrics().apply("numFiles").value())
        children = node.children()
        plan += [children.apply(i) for i in range(children.size())]
    return found


@pytest.fixture(scope="module")
def history(spark):
    path = tempfile.mkdtemp(prefix="seatwise-bookings-") + "/t"
    rows = [t.reservation(i, f"2026-{m:02d}-{d:02d}", 1200, 2) for i, (m, d) in enumerate(((m, d) for m in (9, 10, 11) for d in range(1, 31)), 1)]
    booked = t.reservations(spark, rows)
    write_bookings(booked, path)
    back = read_bookings(spark, path, booked.schema)
    assert sorted(map(tuple, back.select(*booked.columns).collect())) == sorted(rows)
    return back


def asked(spark, days):
    """Requests from a table: its size tells Spark that the days fit a broadcast, which pruning at run time reuses."""
    path = tempfile.mkdtemp(prefix="seatwise-asks-") + "/t"
    rows = t.requests(spark, [t.request(d, f"2026-10-{d:02d}", 1200, 2) for d in days])
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def test_one_day_reads_two_days(spark, history):
    asks = asked(spark, [20])
    peaks = av.max_seated(asks, history, t.cfg(spark))
    assert [r.max_seated for r in peaks.collect()] == [2]
    assert files_read(peaks) == [2]


def test_all_days_are_read_where_all_are_asked(spark, history):
    asks = asked(spark, range(1, 31))
    assert files_read(av.max_seated(asks, history, t.cfg(spark))) == [31]
