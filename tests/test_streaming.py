import datetime as dt
import os
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from seatwise.operators import cases
from seatwise.plans.views import view
from seatwise.streaming.admissions import admission_batches, admitted_rows
from seatwise.streaming.cases import next_reminder_ms, open_cases_stream, reminder_stream
from seatwise.streaming.throttle import throttle_stream, throttle_windows
from tests import tables as t

SF = "/root/testdata/sf0.001"
LAST = {}


def run_stream(spark, rows, name, build, columns=None, files=1):
    """Write ``rows`` as files, read them as a stream, and return everything ``build`` emits."""
    source, check = tempfile.mkdtemp(prefix="seatwise-src-"), tempfile.mkdtemp(prefix="seatwise-chk-")
    rows.repartitionByRange(files, columns or rows.columns[0]).write.mode("overwrite").parquet(source)
    for i, file in enumerate(sorted(Path(source).glob("part-*"))):  # read in the order of the range
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (build(stream).writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", check).trigger(availableNow=True).start())
    try:
        query.awaitTermination(120)
        assert query.exception() is None
        LAST[name] = query.lastProgress
    finally:
        query.stop()
    return spark.table(name)


def state_rows(name):
    """Rows of state after the stream's last batch."""
    return LAST[name].stateOperators[0].numRowsTotal


def test_open_cases_stream_equals_batch(spark):
    """Requests of the whole table in files that overlap by minutes, null sessions among them; a last request moves the watermark on."""
    asks = view(spark, SF, "cases").select(
        "case_id", F.when(F.col("case_id") % 13 != 5, F.col("session_key")).alias("session_key"), "reason", "guest_contact", F.col("created_epoch").alias("epoch"))
    batch = {(r.case_id, r.result, r.existing_id or -1) for r in cases.open_cases(asks).collect()}
    last = spark.createDataFrame([(10**9, -7, "complaint", "x", 4_000_000_000)], asks.schema)
    mixed = asks.withColumn("at", F.col("epoch") + F.pmod(F.hash("case_id"), F.lit(240))).unionByName(last.withColumn("at", F.lit(5_000_000_000)))
    streamed = run_stream(spark, mixed, "opened", lambda s: open_cases_stream(s.drop("at")), "at", files=6)
    assert {(r.case_id, r.result, r.existing_id) for r in streamed.collect()} == batch
    assert {r for _, r, _ in batch} >= {"created", "missing_contact"}
    assert state_rows("opened") <= 4  # the last request and its timer


def test_open_cases_stream_out_of_order_and_late(spark):
    base = 1_000_000_000
    rows = [(0, 1, "a", base + 100), (1, 2, "a", base), (2, 3, "b", base + 50), (3, 9, "c", base + 1000),  # the second came after the first
            (4, 4, "a", base + 10), (4, 5, "b", base + 990), (5, 9, "c", base + 9000), (6, 9, "c", base + 90_000)]
    df = spark.createDataFrame([(i, c, 9 if r == "c" else 1, r, "x", e) for i, c, r, e in rows],
                               "file long, case_id long, session_key long, reason string, guest_contact string, epoch long")
    got = [(r.case_id, r.result, r.existing_id) for r in run_stream(
        spark, df, "order", lambda s: open_cases_stream(s.drop("file")), "file", files=7).collect() if r.session_key == 1]
    assert sorted(got) == [(1, "existing", 2), (2, "created", -1), (3, "created", -1), (4, "late", -1), (5, "created", -1)]


def test_reminder_hours():
    ms = lambda text: int(dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert next_reminder_ms(ms("2026-10-15T10:00:00"), 420) == ms("2026-10-15T10:00:00")
    assert next_reminder_ms(ms("2026-10-15T16:00:00"), 420) == ms("2026-10-16T01:00:00")  # 23:00 local to 08:00
    assert next_reminder_ms(ms("2026-10-15T00:30:00"), 420) == ms("2026-10-15T01:00:00")  # 07:30 local to 08:00


def test_reminder_stream_caps_and_claims(spark):
    start = dt.datetime(2026, 10, 15, 3, 0)
    rows = [(1, "created", "urgent", 0, 1), (2, "created", "normal", 0, 2), (3, "created", "urgent", 0, 3), (3, "claimed", "urgent", 60, 4)]
    # later cases only move the watermark on
    rows += [(100 + i, "claimed", "normal", 300 * (i + 1), 10 + i) for i in range(40)]
    base = int(start.replace(tzinfo=dt.timezone.utc).timestamp())
    df = spark.createDataFrame([(c, e, u, base + s, q) for c, e, u, s, q in rows], "case_id long, event string, urgency string, epoch long, seq long")
    df = df.withColumn("ts", F.timestamp_seconds("epoch"))
    out = run_stream(spark, df, "reminded", lambda s: reminder_stream(s), "epoch", files=10).collect()
    seen = sorted((r.case_id, r.escalation_count) for r in out)
    assert seen == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]
    assert {r.max_reminders for r in out if r.case_id == 1} == {3}


def test_token_bucket_stream(spark):
    rows = [(i, 7, 1000, 10) for i in range(8)] + [(8, 7, 1005, 10), (9, 7, 1006, 9000), (10, 8, 1000, 10)]
    df = spark.createDataFrame(rows, "event_id long, visitor long, epoch long, body_bytes long")
    got = {r.event_id: r.verdict for r in run_stream(spark, df, "bucket", lambda s: throttle_stream(s, "chat")).collect()}
    assert [got[i] for i in range(8)] == ["passed"] * 6 + ["rate_limited"] * 2  # burst of six
    assert got[8] == "passed" and got[9] == "rate_limited" and got[10] == "passed"  # one token every five seconds


def test_throttle_windows_closes_minutes(spark):
    rows = [(1, dt.datetime(2026, 1, 1, 0, 0, i)) for i in range(15)] + [(2, dt.datetime(2026, 1, 1, 0, 30))]
    df = spark.createDataFrame(rows, "visitor long, ts timestamp")
    out = run_stream(spark, df, "minutes", lambda s: throttle_windows(s, "chat"), "ts", files=2).collect()
    assert [(r.visitor, r.requests, r.over_limit) for r in out if r.visitor == 1] == [(1, 15, 3)]


def test_admission_stream_sees_earlier_batches(spark):
    path, source, check = (tempfile.mkdtemp(prefix=f"seatwise-{k}-") for k in ("out", "src", "chk"))
    asks = [t.request(i, "2026-10-20", 1200, 8, customer=i, phone=f"+999 {i}") for i in range(1, 7)]
    first, second = t.requests(spark, asks[:3]), t.requests(spark, asks[3:])
    first.coalesce(1).write.parquet(f"{source}/a")
    stream = spark.readStream.schema(first.schema).option("recursiveFileLookup", "true").parquet(source)

    def tables():
        base = t.reservations(spark, [])
        try:
            base = base.unionByName(admitted_rows(spark.read.parquet(path)), allowMissingColumns=True)
        except Exception:
            pass
        return {"reservations": base, "customers": t.guests(spark, []), "cfg": t.cfg(spark, capacity=40), "hours": t.hours(spark),
                "special_dates": t.specials(spark)}

    for part in (None, second):
        if part is not None:
            part.coalesce(1).write.parquet(f"{source}/b")
        query = (stream.writeStream.foreachBatch(admission_batches(tables, path, lambda _: t.AS_OF))
                 .option("checkpointLocation", check).trigger(availableNow=True).start())
        try:
            query.awaitTermination(120)
            assert query.exception() is None
        finally:
            query.stop()
    got = {r.request_id: r.status for r in spark.read.parquet(path).collect()}
    assert got == {1: "confirmed", 2: "confirmed", 3: "confirmed", 4: "confirmed", 5: "confirmed", 6: "no_availability"}
