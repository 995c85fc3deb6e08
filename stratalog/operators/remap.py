"""Copies between databases whose ids differ: new ids in bulk, a map from old ids to new ones, children rewritten through it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators.work import running, written


def id_map(source: DataFrame, target: DataFrame, id_col: str, keys: Sequence[str]) -> DataFrame:
    """(old_id, new_id) for every row of ``source``; rows are the same where their keys are (null keys too).

    A row that ``target`` has keeps the target's id. Others are numbered behind the target's largest id in the order of
    their keys, rows of one key together: one range sort of the distinct keys. So a copy that is repeated, whole or from
    where it broke off, gives every row the id it has. The map is written, as every child table is read through it.
    """
    columns = [f"k{i}" for i in range(len(keys))]
    named = lambda df, as_: df.select(F.col(id_col).alias(as_), *[F.col(k).alias(c) for k, c in zip(keys, columns, strict=True)])
    old = named(source, "old_id").withColumn("key", F.struct(*columns))
    kept = named(target, "new_id").groupBy(F.struct(*columns).alias("key")).agg(F.min("new_id").alias("new_id"))
    known = old.join(kept, old["key"].eqNullSafe(kept["key"])).select("old_id", "new_id")
    fresh = old.select("key", *columns).distinct().join(kept.select(F.col("key").alias("known")), F.col("key").eqNullSafe(F.col("known")), "left_anti")
    first = (target.agg(F.max(id_col)).first()[0] or 0) + 1
    numbered = running(written(fresh.select(*columns), "fresh"), columns).select(F.struct(*columns).alias("key"), (F.col("rank") + first).alias("new_id"))
    added = old.select("old_id", F.col("key").alias("own")).join(numbered, F.col("own").eqNullSafe(F.col("key"))).select("old_id", "new_id")
    return written(known.unionByName(added), "ids")


def copy_parents(source: DataFrame, target: DataFrame, ids: DataFrame, id_col: str, latest: str) -> DataFrame:
    """``target`` with the rows of ``source`` under their new ids: where both have one, ``latest`` becomes the larger value.

    Of several source rows with one new id that with the smallest old id gives the columns.
    """
    moved = source.join(ids, F.col(id_col) == F.col("old_id")).drop("old_id")
    rest = [c for c in target.columns if c not in (id_col, latest)]
    one = moved.groupBy("new_id").agg(F.min(id_col).alias("first"), F.max(latest).alias("newest"))
    picked = moved.join(one.withColumnRenamed("new_id", "of"), (F.col("new_id") == F.col("of")) & (F.col(id_col) == F.col("first")))
    picked = picked.select(F.col("new_id").alias(id_col), *rest, F.col("newest").alias(latest)).dropDuplicates([id_col])
    bumped = target.join(one.select(F.col("new_id").alias(id_col), "newest"), id_col, "left")
    bumped = bumped.select(id_col, *rest, F.greatest(F.col(latest), F.col("newest")).alias(latest))
    return bumped.unionByName(picked.join(target.select(id_col), id_col, "left_anti"))


def copy_children(source: DataFrame, target: DataFrame, ids: DataFrame, parent: str, key: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """``target`` with the rows of ``source`` whose ``parent`` has a new id; a row whose ``key`` (which has new ids) is there
    already is left out, and of equal new keys one row stays.

    Columns in ``optional`` hold ids too: they are rewritten, or become null where the row they name wasn't copied.
    """
    moved = source
    for column in (parent, *optional):
        pairs = ids.select(F.col("old_id").alias(f"{column} old"), F.col("new_id").alias(f"{column} new"))
        moved = moved.join(pairs, F.col(column) == F.col(f"{column} old"), "inner" if column == parent else "left")
        moved = moved.withColumn(column, F.col(f"{column} new")).drop(f"{column} old", f"{column} new")
    moved = moved.select(*target.columns)
    own = F.struct(*[F.col(c) for c in target.columns])
    one = moved.groupBy(*key).agg(F.min(own).alias("row")).select("row.*")
    same = [one[k].eqNullSafe(target[k]) for k in key]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return target.unionByName(one.join(target, condition, "left_anti"))
