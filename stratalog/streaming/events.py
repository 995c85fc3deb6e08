"""Event operators on streams. Event time is a timestamp with a watermark; state is per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 10) -> DataFrame:
    """Parquet files of events as a stream; ``ts`` without a zone is taken as UTC."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, ts: str, width: str, late: str, *group: str) -> DataFrame:
    """Events of each group in windows of ``width``; events later than ``late`` are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *group).agg(F.count("*").alias("n"))


def session_windows(events: DataFrame, ts: str, gap: str, late: str, *group: str) -> DataFrame:
    """Sessions that a pause of ``gap`` ends; each is emitted when the watermark has passed it."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *group).agg(F.count("*").alias("n_events"))


def failure_windows(events: DataFrame, ts: str, width: str, slide: str, late: str, least: int, *group: str) -> DataFrame:
    """Sliding windows with at least ``least`` events of a group; give it failures only."""
    windows = events.withWatermark(ts, late).groupBy(F.window(ts, width, slide), *group).agg(F.count("*").alias("failures"))
    return windows.where(F.col("failures") >= least)


def once(events: DataFrame, ts: str, late: str, *key: str) -> DataFrame:
    """The first event of each key, within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(key))


def changes_only(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Events whose value differs from the last one of their key. The last value is kept over restarts.

    Within a batch, events of a key are taken in the order of ``order``. Columns: key, order, value.
    """
    narrow = events.select(key, order, value)
    kinds = dict(narrow.dtypes)

    def emit(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(order)
        before = rows[value].shift(1)
        before.iloc[0] = last
        state.update((rows[value].iloc[-1],))
        yield rows[rows[value] != before]

    return narrow.groupBy(key).applyInPandasWithState(
        emit,
        f"{key} {kinds[key]}, {order} {kinds[order]}, {value} {kinds[value]}",
        f"last {kinds[value]}",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over all there is into a memory table, for tests and backfills of small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return stream.sparkSession.table(name)


def append_jsonl(stream: DataFrame, path: str, checkpoint: str):
    """Write a stream as JSON lines; the file sink takes each batch once."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
