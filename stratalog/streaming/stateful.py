"""Streams with value state, list state and event-time timers: sessions that are reaped, and events released in order.

State lies in RocksDB (``transformWithState`` needs it) and is checkpointed with the stream, so a restart goes on where
the last run ended. What is later than the watermark is dropped before it gets here.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> None:
    """Let new streams of the session keep their state in RocksDB; streams with a checkpoint keep what they began with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


class _Sessions(StatefulProcessor):
    """Open sessions of a key, which do not overlap; a timer for each."""

    def __init__(self, key: str, timeout_us: int, tick_us: int) -> None:
        self.key, self.timeout, self.tick = key, timeout_us, tick_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "started long, ended long, n long")

    def _expiry(self, ended: int) -> int:
        """The first millisecond at which a session is over for good."""
        return (ended + self.timeout) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        spans = [tuple(map(int, s)) for s in self.open.get()] if self.open.exists() else []
        for _, ended, _ in spans:
            self.handle.deleteTimer(self._expiry(ended))
        spans += [(int(at), int(at), 1) for frame in rows for at in frame["at"]]
        merged: list[tuple[int, int, int]] = []
        for started, ended, n in sorted(spans):
            if merged and started - merged[-1][1] <= self.timeout:
                merged[-1] = (merged[-1][0], max(ended, merged[-1][1]), n + merged[-1][2])
            else:
                merged.append((started, ended, n))
        self.open.put(merged)
        for _, ended, _ in merged:
            self.handle.registerTimer(self._expiry(ended))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        over = expiredTimerInfo.getExpiryTimeInMs()
        spans = [tuple(map(int, s)) for s in self.open.get()] if self.open.exists() else []
        done = [s for s in spans if self._expiry(s[1]) <= over]
        left = [s for s in spans if self._expiry(s[1]) > over]
        if left:
            self.open.put(left)
        else:
            self.open.clear()
        if done:
            frame = pd.DataFrame(done, columns=["started", "ended", "n_events"])
            # A reaper that looks every tick finds a session dead at the first look after its timeout.
            frame["reaped"] = (frame["ended"] + self.timeout) // self.tick * self.tick + self.tick
            frame.insert(0, self.key, key[0])
            yield frame

    def close(self) -> None:
        pass


def reaped_sessions(events: DataFrame, key: str, ts: str, late: str, timeout_seconds: int = 60, tick_seconds: int = 20) -> DataFrame:
    """Sessions of a key, each emitted once the watermark has passed its last event by more than the timeout.

    key, started, ended, n_events and reaped: the first multiple of ``tick_seconds`` after the timeout. A pause of more
    than the timeout begins a new session, whichever batches its events come in. Null times are left out.
    """
    spark = events.sparkSession
    with_rocksdb(spark)
    rows = events.withWatermark(ts, late).where(F.col(ts).isNotNull()).select(F.col(key), F.col(ts), F.unix_micros(ts).alias("at"))
    kind = dict(rows.dtypes)[key]
    out = rows.groupBy(key).transformWithStateInPandas(
        _Sessions(key, timeout_seconds * 1_000_000, tick_seconds * 1_000_000), f"`{key}` {kind}, started long, ended long, n_events long, reaped long", "append", "EventTime"
    )
    return out.select(key, *[F.timestamp_micros(c).alias(c) for c in ("started", "ended")], "n_events", F.timestamp_micros("reaped").alias("reaped"))


class _Ordered(StatefulProcessor):
    """Rows of a key wait until the watermark has passed them, and leave in order, with a number each."""

    def __init__(self, columns: Sequence[str], schema: str, order: Sequence[str], value: str | None) -> None:
        self.columns, self.schema, self.order, self.value = list(columns), schema, list(order), value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.last = handle.getValueState("last", "number long, seen boolean, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for frame in rows:
            frame = frame[self.columns]
            self.waiting.appendList([tuple(None if v is None or v != v else v for v in r) for r in frame.itertuples(index=False, name=None)])
            first = min(x for x in (first, int(frame["at"].min())) if x is not None)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        at = self.columns.index("at")
        out = [r for r in rows if r[at] <= passed]
        left = [r for r in rows if r[at] > passed]
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(min(r[at] for r in left) // 1000 + 1)
        else:
            self.waiting.clear()
        if not out:
            return
        places = [self.columns.index(c) for c in self.order]
        out.sort(key=lambda r: [(r[p] is not None, r[p]) for p in places])
        number, seen, last = self.last.get() if self.last.exists() else (0, False, None)
        kept = []
        for r in out:
            number += 1
            value = None if self.value is None else r[self.columns.index(self.value)]
            if self.value is None or not seen or value != last:
                kept.append((*r, number))
            seen, last = True, value
        self.last.update((int(number), seen, last))
        if kept:
            yield pd.DataFrame(kept, columns=[*self.columns, "number"])

    def close(self) -> None:
        pass


def _released(rows: DataFrame, key: str, ts: str, order: Sequence[str], value: str | None) -> DataFrame:
    spark = rows.sparkSession
    with_rocksdb(spark)
    given = rows.withColumn("at", F.unix_micros(ts))
    columns = [c for c in given.columns if c not in (key, ts)]
    kinds = dict(given.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    out = given.groupBy(key).transformWithStateInPandas(_Ordered(columns, schema, ["at", *order], value), f"{schema}, number long", "append", "EventTime")
    return out.withColumn(ts, F.timestamp_micros("at")).drop("at")


def merged_stream(streams: Sequence[DataFrame], ts: str, late: str, ties: Sequence[str]) -> DataFrame:
    """Several streams of the same columns as one under one watermark, numbered within each day by time and then ``ties``.

    The watermark is that of the union, so the slower stream holds back the faster one. A day is a key: days are numbered in
    parallel, and the rows that wait are those within the watermark's delay. Rows without a time are left out.
    """
    both = functools.reduce(DataFrame.unionByName, streams).where(F.col(ts).isNotNull()).withWatermark(ts, late)
    out = _released(both.withColumn("day", F.to_date(ts)), "day", ts, ties, None)
    return out.withColumn("day", F.to_date(ts))


def changes_of_all(events: DataFrame, ts: str, late: str, order: str, value: str) -> DataFrame:
    """Events whose value (a string) differs from the one before them in one order of all events; the first is a change.

    One state for all events means one task, which gets three columns alone; what waits are the events within the
    watermark's delay. For histories use the batch operator, which sorts by ranges.
    """
    rows = events.where(F.col(ts).isNotNull()).withWatermark(ts, late).select(ts, order, value, F.lit(0).alias("all"))
    return _released(rows, "all", ts, [order], value).select(ts, order, value)
