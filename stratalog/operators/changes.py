"""Changes between states: fact diffs, set diffs, deltas over epochs, retention, provenance of merged values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.operators.work import running, written


def fact_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """added, removed and modified keys with both values; keys that agree (nulls are equal) are left out."""
    b = before.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("in_old"))
    a = after.select(*keys, F.col(value).alias("new_value"), F.lit(True).alias("in_new"))
    kind = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("modified")
    both = b.join(a, list(keys), "full_outer").withColumn("change_type", kind)
    changed = (F.col("change_type") != "modified") | ~F.col("old_value").eqNullSafe(F.col("new_value"))
    return both.where(changed).select(*keys, "old_value", "new_value", "change_type")


def consecutive_diff(facts: DataFrame, group: str, epoch: str, keys: Sequence[str], value: str, last: DataFrame | None = None) -> DataFrame:
    """``fact_diff`` of each epoch of each group with the epoch before; ``epoch`` is the later one.

    Every fact counts once as new in its epoch and once as old in the next one, so one aggregation makes all diffs. The
    last epoch of a group has no next one: that is a second, small aggregation, unless ``last`` (group, last_epoch) is
    given, as where a last epoch can be without facts.
    """
    last = facts.groupBy(group).agg(F.max(epoch).alias("last_epoch")) if last is None else last
    sides = F.explode(F.array(F.struct(F.lit(0).alias("age"), F.col(epoch).alias("to")), F.struct(F.lit(1).alias("age"), (F.col(epoch) + 1).alias("to"))))
    both = facts.select(group, *keys, F.col(value).alias("value"), sides.alias("s")).where("s.to > 1")
    pick = lambda age: F.max(F.when(F.col("s.age") == age, F.struct("value")))
    folded = both.groupBy(group, F.col("s.to").alias(epoch), *keys).agg(pick(1).alias("old"), pick(0).alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified")
    folded = folded.withColumn("change_type", kind).where((F.col("change_type") != "modified") | ~F.col("old.value").eqNullSafe(F.col("new.value")))
    found = folded.join(last, group).where(F.col(epoch) <= F.col("last_epoch"))
    return found.select(group, epoch, *keys, F.col("old.value").alias("old_value"), F.col("new.value").alias("new_value"), "change_type")


def epoch_changes(facts: DataFrame, group: str, epoch: str, keys: Sequence[str], value: str, first: str, last: str) -> DataFrame:
    """``consecutive_diff`` of the epochs from ``first`` to ``last``, columns that are alike for all facts of a group.

    There is one fact for a key and epoch. A fact is compared with its neighbours in the key's own row of epochs, so it is
    shuffled once, and not at all where facts come by group.
    """
    w = Window.partitionBy(group, *keys).orderBy(epoch)
    near = {"e-": F.lag(epoch).over(w), "v-": F.lag(value).over(w), "e+": F.lead(epoch).over(w)}
    rows = facts.select(group, *keys, F.col(epoch).cast("int").alias("e"), F.col(value).alias("v"), first, last, *[c.alias(n) for n, c in near.items()])
    follows = F.coalesce(F.col("e-") == F.col("e") - 1, F.lit(False))
    change = lambda at, old, new, kind: F.struct(at.alias("e"), old.alias("old"), new.alias("new"), kind.alias("kind"))
    none = F.lit(None).cast(facts.schema[value].dataType)
    here = change(F.col("e"), F.when(follows, F.col("v-")), F.col("v"), F.when(follows, "modified").otherwise("added"))
    here = F.when((F.col("e") > 1) & (F.col("e") >= F.col(first)) & ~(follows & F.col("v").eqNullSafe(F.col("v-"))), here)
    gone = F.when((F.col("e") < F.col(last)) & ~F.coalesce(F.col("e+") == F.col("e") + 1, F.lit(False)), change(F.col("e") + 1, F.col("v"), none, F.lit("removed")))
    found = rows.select(group, *keys, F.explode(F.array_compact(F.array(here, gone))).alias("c"))
    return found.select(group, F.col("c.e").alias(epoch), *keys, F.col("c.old").alias("old_value"), F.col("c.new").alias("new_value"), F.col("c.kind").alias("change_type"))


def tree_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], tag: str) -> DataFrame:
    """Paths (the keys) that were added, removed, or are there with another tag (moved)."""
    diff = fact_diff(before, after, keys, tag)
    return diff.withColumn("change_type", F.when(F.col("change_type") == "modified", "moved").otherwise(F.col("change_type")))


def layout_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], least: float = 4.0, share: float = 0.10) -> DataFrame:
    """Elements (x, y, w, h) in both that moved by ``least`` or more, or changed a side by more than ``share`` of the old one."""
    side = lambda df, n: df.select(*keys, *[F.col(c).alias(f"{c}_{n}") for c in "xywh"])
    both = side(before, 0).join(side(after, 1), list(keys))
    d = {f"d{c}": F.col(f"{c}_1") - F.col(f"{c}_0") for c in "xywh"}
    grown = lambda c: F.when(F.col(f"{c}_0") > 0, F.abs(d[f"d{c}"]) / F.col(f"{c}_0")).otherwise(F.lit(0.0)) > share
    moved, resized = (F.abs(d["dx"]) >= least) | (F.abs(d["dy"]) >= least), grown("w") | grown("h")
    out = both.select(*keys, *[v.alias(k) for k, v in d.items()], moved.alias("moved"), resized.alias("resized"))
    return out.where("moved OR resized")


def set_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct rows that only one side has, with ``change``: added or removed."""
    gone = before.subtract(after).withColumn("change", F.lit("removed"))
    return gone.unionByName(after.subtract(before).withColumn("change", F.lit("added")))


def deltas(rows: DataFrame, group: Sequence[str], order: Sequence[str], columns: Sequence[str], first_is_zero: bool = False) -> DataFrame:
    """``c_delta``: change of each column since the row before; null (or 0) for the first row."""
    w = Window.partitionBy(*group).orderBy(*order)
    change = {f"{c}_delta": F.col(c) - F.lag(c).over(w) for c in columns}
    return rows.withColumns({k: F.coalesce(v, F.lit(0)) if first_is_zero else v for k, v in change.items()})


def gc_candidates(snapshots: DataFrame, group: str, order: Sequence[str], keep_latest: int, column: str, cutoff) -> DataFrame:
    """Snapshots beyond the ``keep_latest`` newest of their group that are also older than the cutoff."""
    newest = Window.partitionBy(group).orderBy(*[F.desc(c) for c in order])
    ranked = snapshots.withColumn("rn", F.row_number().over(newest))
    return ranked.where((F.col("rn") > keep_latest) & (F.col(column) < cutoff))


def overlay(static: DataFrame, live: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Merged values: live over static, and where each comes from (static, live or both)."""
    s = static.select(*keys, F.col(value).alias("static_value"), F.lit(True).alias("in_static"))
    x = live.select(*keys, F.col(value).alias("live_value"), F.lit(True).alias("in_live"))
    both = s.join(x, list(keys), "full_outer")
    source = F.when(F.col("in_live").isNull(), "static").when(F.col("in_static").isNull(), "live").otherwise("both")
    return both.select(*keys, F.coalesce("live_value", "static_value").alias("value"), source.alias("provenance"))


def first_of_group(rows: DataFrame, group: Sequence[str], order: Sequence, most: int) -> DataFrame:
    """The first ``most`` rows of each group; Spark drops rows of higher ranks before the shuffle already."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def running_budget(rows: DataFrame, group: str, order: Sequence, cost: str, budget: int) -> DataFrame:
    """Rows of each group, in order, up to the first one whose running cost exceeds the budget.

    Costs are not negative, and the first column of ``order`` is a number. Its values are cut into powers of two; cells
    that begin beyond the budget are dropped by their sums before any group is sorted, so a task sorts about a budget.
    """
    placed = rows.withColumn("cell", F.floor(F.log2(F.greatest(F.col(order[0]).cast("double"), F.lit(0.0)) + 1)))
    sums = placed.groupBy(group, "cell").agg(F.sum(cost).alias("cell cost"))
    before = F.sum("cell cost").over(Window.partitionBy(group).orderBy("cell")) - F.col("cell cost")
    live = sums.select(F.col(group).alias("live group"), F.col("cell").alias("live cell"), before.alias("before")).where(F.col("before") <= budget)
    near = placed.join(live, F.col(group).eqNullSafe(F.col("live group")) & (F.col("cell") == F.col("live cell")), "left_semi").drop("cell")
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return near.withColumn("running", F.sum(cost).over(w)).where(F.col("running") <= budget)


def ranked_within_budget(
    rows: DataFrame, signal: str, size: str, ref: str, source_length: str, most_bytes: int = 0, most_rows: int = 0, most_tokens: int = 0
) -> DataFrame:
    """The best rows that fit: by signal and size, largest first, then ``ref``; with ``place`` from 1 and ``tokens`` so far.

    Rows of more than ``most_bytes`` are left out, and ``most_rows`` are taken at most. A row costs a quarter of its
    source's length in whole tokens; the first row that would exceed ``most_tokens`` ends the list. 0 is no limit. One range
    sort with running sums over all rows, whatever the budget.
    """
    small = rows.where(F.col(size) <= most_bytes) if most_bytes > 0 else rows
    cost = small.withColumn("tokens here", F.floor(F.coalesce(F.col(source_length), F.lit(0)) / 4).cast("long"))
    ranked = running(written(cost, "candidates"), [F.desc(signal), F.desc(size), F.col(ref)], ["tokens here"])
    out = ranked.select(*rows.columns, (F.col("rank") + 1).alias("place"), (F.col("tokens here_before") + F.col("tokens here")).alias("tokens"))
    out = out.where(F.col("place") <= most_rows) if most_rows > 0 else out
    return out.where(F.col("tokens") <= most_tokens) if most_tokens > 0 else out
