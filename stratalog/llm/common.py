"""Helpers that several operators share: small batches, packed columns, words; written tables and running sums from ``work``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.operators.work import forget, running, scratch, shared_dir, written

__all__ = ["BATCH_BYTES", "ascii_lower", "forget", "in_small_batches", "packed", "running", "scratch", "shared_dir", "small_batches", "spare_name", "word_count", "written"]

#: A word is a run of characters other than ASCII white space.
SPACES = r"[ \t\n\x0B\f\r]+"

_ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Arrow batches that Spark sends to a worker hold about this many bytes at most (or one row).
BATCH_BYTES = 4 << 20


def in_small_batches(spark: SparkSession) -> None:
    """Let Spark send Arrow batches of bounded bytes to workers, unless the session has a bound of its own already.

    The default is bounded in rows alone, so batches of long texts would be of any size. A plan reads the setting
    when it runs, so it stays set.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if bound > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def small_batches(batches: Iterator[pa.RecordBatch], column: int, rows: int = 256, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and ``most`` bytes of a binary or string column (or one row),
    so that a worker holds few texts as Python objects at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + most, "right"))))
            yield batch.slice(at, to - at)
            at = to


def spare_name(names: Sequence[str]) -> str:
    """A name that none of ``names`` is, in whatever case."""
    spare = "and no more"
    while spare in {c.lower() for c in names}:
        spare += " still"
    return spare


def packed(df: DataFrame, apart: Sequence[str] = ()) -> Column:
    """All columns of ``df`` but those ``apart`` as one struct, so that no name of theirs meets a name used inside.

    A struct must have a field; the one added here is named as no column is."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in apart], F.lit(0).alias(spare_name(df.columns)))


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(text, _ASCII_UPPER, _ASCII_UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of words of a text, as long; null counts as 0."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != ""))
    return words.cast("long")
