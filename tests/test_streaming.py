from pyspark.sql import functions as F
from stratalog.operators import events as batch
from stratalog.streaming import events as stream

SF_DIR = "/root/testdata/sf0.001"


def source(spark, tmp_path):
    """The events in four files, by time."""
    rows = spark.read.parquet(f"{SF_DIR}/events.parquet")
    for i, part in enumerate(((0, 8), (8, 16), (16, 24), (24, 32))):
        day = F.dayofmonth("ts")
        rows.where((day >= part[0]) & (day < part[1])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return rows, stream.event_stream(spark, str(tmp_path / "in"), rows.schema, 1)


def test_change_only_stream_as_batch(spark, tmp_path):
    rows, events = source(spark, tmp_path)
    got = stream.run_available(stream.changes_only(events, "user_id", "event_id", "event_type"), "changes", "append", str(tmp_path / "c1"))
    want = batch.changes_only(rows, "user_id", ["event_id"], "event_type").select("user_id", "event_id", "event_type")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tumbling_counts_as_batch(spark, tmp_path):
    rows, events = source(spark, tmp_path)
    got = stream.run_available(stream.tumbling_counts(events, "ts", "1 day", "40 days", "event_type"), "tumbling", "complete", str(tmp_path / "c2"))
    want = rows.groupBy(F.to_date("ts").alias("d"), "event_type").count()
    assert sorted((str(r.window.start)[:10], r.event_type, r.n) for r in got.collect()) == sorted((str(r.d), r.event_type, r["count"]) for r in want.collect())


def test_sessions_and_failures_run(spark, tmp_path):
    rows, events = source(spark, tmp_path)
    sessions = stream.run_available(stream.session_windows(events, "ts", "1 day", "1 hour", "user_id"), "sessions", "append", str(tmp_path / "c3"))
    whole = batch.sessions(rows, "user_id", "ts", "event_id", 86_400).count()
    assert 0 < sessions.count() <= whole
    failures = stream.failure_windows(events.where("event_type = 'error'"), "ts", "2 days", "1 day", "40 days", 2, "user_id")
    assert stream.run_available(failures, "failures", "complete", str(tmp_path / "c4")).where("failures < 2").count() == 0


def test_each_key_once(spark, tmp_path):
    rows, events = source(spark, tmp_path)
    got = stream.run_available(stream.once(events, "ts", "40 days", "event_id"), "once", "append", str(tmp_path / "c5"))
    assert got.count() == rows.count()
