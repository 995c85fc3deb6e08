"""Times: milliseconds, a browser's microseconds since 1601, ages, text, and links with a grace period."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: microseconds from 1601 to 1970.
CHROMIUM_EPOCH = 11_644_473_600_000_000


def to_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def from_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def to_chromium(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) + CHROMIUM_EPOCH


def from_chromium(micros: Column) -> Column:
    """Null for 0, which stands for no time."""
    return F.when(micros != 0, F.timestamp_micros(micros - CHROMIUM_EPOCH))


def age_seconds(ts: Column, now: dt.datetime) -> Column:
    """Whole seconds from ``ts`` to ``now``, which is given so that a query gives the same again; both in UTC."""
    return F.unix_seconds(F.lit(now).cast("timestamp_ntz").cast("timestamp")) - F.unix_seconds(ts.cast("timestamp"))


def iso(ts: Column) -> Column:
    return F.regexp_replace(F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssx"), "Z$", "+00")


def within_grace(rows: DataFrame, sources: DataFrame, key: str, seen: str, captured: str, seconds: int) -> DataFrame:
    """Rows seen no earlier than ``seconds`` before their key's source was captured."""
    both = rows.join(sources, key)
    return both.where(F.unix_micros(F.col(seen).cast("timestamp")) >= F.unix_micros(F.col(captured).cast("timestamp")) - seconds * 1_000_000)
