"""Streams with timers against the batch operators, in several batches and over a restart."""

import datetime as dt
import os
import shutil
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from stratalog.operators import events as batch
from stratalog.streaming import events as stream
from stratalog.streaming import stateful

SF_DIR = "/root/testdata/sf0.001"
FLUSH = dt.datetime(2100, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{SF_DIR}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).cache()


@pytest.fixture(scope="module")
def parts(rows, tmp_path_factory):
    """Five files; some events of the first two lie two files later, within the delay that most tests give."""
    folder = tmp_path_factory.mktemp("parts")
    n = rows.count()
    place = F.row_number().over(Window.orderBy("ts")) - 1
    numbered = rows.withColumn("part", F.least(F.lit(3), (place * 4 / n).cast("int")) + F.when((place % 97 == 3) & (place * 4 < 2 * n), 2).otherwise(0)).cache()
    for i in range(4):
        numbered.where(F.col("part") == i).drop("part").coalesce(1).write.parquet(f"{folder}/{i}")
    last = rows.limit(1).withColumn("ts", F.lit(FLUSH).cast("timestamp")).withColumn("event_id", F.lit(-1).cast("long")).withColumn("user_id", F.lit(-1).cast("long"))
    last.coalesce(1).write.parquet(f"{folder}/4")
    return folder


def give(parts, to, numbers):
    """Hand files over in this order; the source reads them by age."""
    for i in numbers:
        for f in sorted((parts / str(i)).glob("*.parquet")):
            shutil.copy(f, to / f"{i}.parquet")
            os.utime(to / f"{i}.parquet", (time.time() - 100 + i, time.time() - 100 + i))


def run(spark, tmp_path, parts, rows, make, runs):
    """The rows that a stream wrote in all its runs, each from where the last one ended."""
    source = tmp_path / "in"
    source.mkdir()
    for numbers in runs:
        give(parts, source, numbers)
        out = make(stream.event_stream(spark, f"file://{source}", rows.schema, 1))
        query = out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/point").trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
    return spark.read.parquet(f"file://{tmp_path}/out")


LATE = "400 days"


@pytest.mark.parametrize("runs", [[[0, 1, 2, 3, 4]], [[0, 1], [2], [3, 4]]])
def test_reaper_as_batch(spark, tmp_path, parts, rows, runs):
    hours = 36
    got = run(spark, tmp_path, parts, rows, lambda e: stateful.reaped_sessions(e, "user_id", "ts", LATE, hours * 3600, 1200), runs).collect()
    want = batch.sessions(rows, "user_id", "ts", "event_id", hours * 3600).collect()
    assert sorted((r.user_id, r.started, r.ended, r.n_events) for r in got if r.user_id >= 0) == sorted((r.user_id, r.started, r.ended, r.n_events) for r in want)
    for r in got:
        over = r.ended + dt.timedelta(hours=hours)
        assert r.reaped > over and r.reaped - over <= dt.timedelta(seconds=1200) and r.reaped.second == 0 and r.reaped.minute % 20 == 0


@pytest.mark.parametrize("runs", [[[0, 1, 2, 3, 4]], [[0], [1, 2], [3, 4]]])
def test_global_changes_as_batch(spark, tmp_path, parts, rows, runs):
    got = run(spark, tmp_path, parts, rows, lambda e: stateful.changes_of_all(e, "ts", LATE, "event_id", "event_type"), runs)
    want = batch.changes_of_all(rows.select("ts", "event_id", "event_type"), "ts", "event_id", "event_type").collect()
    assert sorted(map(tuple, got.where("event_id >= 0").select("ts", "event_id", "event_type").collect())) == sorted(map(tuple, want))


def test_merged_streams_as_batch(spark, tmp_path, parts, rows):
    def make(events):
        one = events.where("event_id % 3 <> 0").select("ts", "event_id", F.lit("a").alias("origin"))
        other = stream.event_stream(spark, f"file://{tmp_path}/in", rows.schema, 1).where("event_id % 3 = 0").select("ts", "event_id", F.lit("b").alias("origin"))
        return stateful.merged_stream([one, other], "ts", LATE, ["origin", "event_id"])

    got = run(spark, tmp_path, parts, rows, make, [[0, 1, 2], [3, 4]]).where("event_id >= 0")
    sides = [rows.where(f"event_id % 3 {op} 0").select("ts", "event_id", F.lit(o).alias("origin")) for op, o in (("<>", "a"), ("=", "b"))]
    want = batch.merged(sides, "ts", ["origin", "event_id"])
    key = lambda df: sorted(map(tuple, df.select("day", "number", "origin", "event_id").collect()))
    assert key(got) == key(want)


def test_late_events_are_dropped(spark, tmp_path, parts, rows):
    """With a short delay what comes too late has no part, and nothing else is lost."""
    got = run(spark, tmp_path, parts, rows, lambda e: stateful.merged_stream([e.select("ts", "event_id")], "ts", "0 seconds", ["event_id"]), [[0, 1, 2, 3, 4]])
    ids = [r.event_id for r in got.collect() if r.event_id >= 0]
    assert len(ids) == len(set(ids)) and 0.97 * rows.count() <= len(ids) < rows.count()
