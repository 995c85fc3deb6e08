"""Event logs: roll-ups, rates, drift, sessions, guards and change-only emission, as batch queries."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions import score as S
from stratalog.operators.work import running, written


def rollup(events: DataFrame, group: Sequence[str], kind: str, kinds: dict[str, str]) -> DataFrame:
    """Counts of events by kind and rates of failures and retries among invocations (0 without any)."""
    counted = events.groupBy(*group).agg(*[F.count(F.when(F.col(kind) == k, 1)).alias(name) for name, k in kinds.items()])
    return counted.withColumns({f"{c}_rate": S.ratio(F.col(c), F.col("invocations")) for c in kinds if c != "invocations"})


def index_quantiles(values: DataFrame, column: str, quantiles: dict[str, float], cells: int = 4096) -> DataFrame:
    """Quantiles by index (no interpolation) of a whole column, without collecting it into one row.

    Counts of distinct values are combined first, and cut into ``cells`` ranges of equal width: running counts of the
    ranges say which values of a range to add, so no task orders more than one range.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"), F.sum("n").alias("total"))
    width = F.greatest((F.col("hi") - F.col("lo")) / cells, F.lit(1e-300))
    cell = F.least(F.floor((F.col(column).cast("double") - F.col("lo")) / width), F.lit(cells - 1))
    placed = counts.join(F.broadcast(ends)).withColumn("cell", cell)
    before = placed.groupBy("cell").agg(F.sum("n").alias("m"))
    before = before.select("cell", (F.sum("m").over(Window.orderBy("cell")) - F.col("m")).alias("before"))
    w = Window.partitionBy("cell").orderBy(column)
    ranked = placed.join(F.broadcast(before), "cell").withColumn("upto", F.col("before") + F.sum("n").over(w))
    at = lambda q: F.least(F.floor(F.col("total") * q), F.col("total") - 1)
    return ranked.agg(*[F.min(F.when(F.col("upto") > at(q), F.col(column))).alias(name) for name, q in quantiles.items()], F.max(column).alias("max"))


def sessions(events: DataFrame, group: str, ts: str, order: str, gap_seconds: int) -> DataFrame:
    """Sessions of each group: a gap longer than ``gap_seconds`` begins a new one."""
    w = Window.partitionBy(group).orderBy(ts, order)
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1_000_000
    new = F.coalesce((seconds(F.col(ts)) - seconds(F.lag(ts).over(w)) > gap_seconds).cast("int"), F.lit(1))
    numbered = events.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return numbered.groupBy(group, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n_events"))


def failure_guard(events: DataFrame, group: str, ts: str, failed: Column, seconds: int, least: int = 3) -> DataFrame:
    """Failed events with at least ``least`` failures of the group in the ``seconds`` up to and with them.

    A failure as long ago as ``seconds`` to the microsecond is out.
    """
    moment = events.where(failed).withColumn("moment", F.unix_micros(F.col(ts).cast("timestamp")))
    w = Window.partitionBy(group).orderBy("moment").rangeBetween(1 - seconds * 1_000_000, 0)
    return moment.withColumn("failures", F.count("*").over(w)).where(F.col("failures") >= least).drop("moment")


def changes_only(events: DataFrame, group: str, order: Sequence[str], value: str) -> DataFrame:
    """Events whose value differs from the one before in their group; the first is a change."""
    w = Window.partitionBy(group).orderBy(*order)
    before = F.lag(value).over(w)
    first = F.row_number().over(w) == 1
    return events.withColumn("changed", first | ~before.eqNullSafe(F.col(value))).where("changed").drop("changed")


def split_with_remainder(rows: DataFrame, group: str, order: Sequence[str], total: str) -> DataFrame:
    """Split a group's total evenly in whole numbers; the last row takes the remainder."""
    w = Window.partitionBy(group)
    n = F.count("*").over(w)
    share = F.floor(F.col(total) / n).cast("long")
    last = F.row_number().over(w.orderBy(*order)) == n
    return rows.withColumn("share", share + F.when(last, F.col(total) - share * n).otherwise(F.lit(0)))


def file_category(kind: Column) -> Column:
    """Kinds of changes of files; others are null and are to be dropped."""
    return F.when(kind.contains("urgent"), "create").when(kind.contains("high"), "modify").when(kind.contains("low"), "delete")


def merged(streams: Sequence[DataFrame], ts: str, ties: Sequence[str]) -> DataFrame:
    """Several streams as one, with ``day`` and ``number``: the place within the day from 1, by time and then ``ties``.

    One range sort of all rows; a day's numbers are ranks less the day's first one, so no task orders a day.
    """
    both = functools.reduce(DataFrame.unionByName, streams).withColumn("day", F.to_date(ts))
    ranked = running(written(both, "merged"), ["day", ts, *ties])
    first = ranked.groupBy("day").agg(F.min("rank").alias("first"))
    placed = ranked.join(first.withColumnRenamed("day", "of"), F.col("day").eqNullSafe(F.col("of")))
    return placed.select(*both.columns, (F.col("rank") - F.col("first") + 1).cast("int").alias("number"))


#: Rows in a row of which one task looks back at the row before.
LOOK_BACK = 100_000


def changes_of_all(events: DataFrame, ts: str, order: str, value: str) -> DataFrame:
    """Events whose value differs from the one before, in one order of all events; the first is a change.

    One range sort gives ranks; blocks of LOOK_BACK ranks look back within themselves, and the first of a block at the last
    of the block before, which a join on the block's number finds.
    """
    ranked = running(written(events, "events"), [ts, order]).withColumn("block", F.expr(f"rank div {LOOK_BACK}"))
    own = F.struct(F.col(value).alias("v"))
    last = ranked.where((F.col("rank") + 1) % LOOK_BACK == 0).select((F.col("block") + 1).alias("block"), own.alias("before block"))
    w = Window.partitionBy("block").orderBy("rank")
    before = F.coalesce(F.lag(own).over(w), F.col("before block"))
    both = ranked.join(last, "block", "left").withColumn("before", before)
    return both.where(F.col("before").isNull() | ~F.col("before.v").eqNullSafe(F.col(value))).select(*events.columns)


def storage_category(path: Column) -> Column:
    """What an application keeps in a file, by its path; ``unknown`` for anything else."""
    folder, base = F.regexp_extract(path, "^(.*?)/*[^/]*$", 1), F.element_at(F.split(path, "/"), -1)
    return (
        F.when(folder.contains("Local Storage"), "localstorage")
        .when(folder.contains("leveldb"), "leveldb")
        .when(base.endswith(".ldb") | base.endswith(".log"), "unknown")
        .when(base.isin("Cookies", "Cookies-journal"), "cookies")
        .when(base.isin("Preferences", "Secure Preferences"), "preferences")
        .when(base.endswith(".sqlite") | base.endswith(".db"), "sqlite")
        .otherwise("unknown")
    )


def storage_events(changes: DataFrame, path: str, operation: str, size: str, root: str) -> DataFrame:
    """Changes of files as events: type, path below ``root``, operation, category, size_delta (0 for deletions).

    Operations other than create, modify and delete, and files of no known category, are dropped. Every step is a
    projection or a filter, so it works on a stream as on a table.
    """
    kept = changes.where(F.col(operation).isin("create", "modify", "delete")).withColumn("category", storage_category(F.col(path))).where("category <> 'unknown'")
    head = root.rstrip("/") + "/"
    below = F.when(F.col(path).startswith(head), F.substr(F.col(path), F.lit(len(head) + 1))).otherwise(F.col(path))
    gone = F.col(operation) == "delete"
    made = {"type": F.when(gone, "storage.delete").otherwise("storage.write"), path: below, "size_delta": F.when(gone, 0).otherwise(F.coalesce(F.col(size), F.lit(0))).cast("long")}
    return kept.withColumns(made)
