"""Rows by key: representatives, propagation over content hashes, latest rows, tombstones, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def representatives(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order (ascending, nulls first), which must be total.

    An aggregate that combines before the shuffle, so no task sorts the rows of a key.
    """
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("best"))
    return best.select("best.*")


def propagate(rows: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """Fill nulls of ``column`` from the first row of the same key that has a value.

    One aggregation with map-side combining and one join; a hot key is a single row after the aggregation.
    """
    found = rows.where(F.col(column).isNotNull()).groupBy(key).agg(F.min_by(column, order).alias("found"))
    return rows.join(found, key, "left").withColumn(column, F.coalesce(column, "found")).drop("found")


def latest(rows: DataFrame, key: str, order: Column, columns: Sequence[str]) -> DataFrame:
    """The columns of the latest row of each key."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("best"))
    return best.select(key, *[F.col(f"best.{c}").alias(c) for c in columns])


def repeated(rows: DataFrame, key: str, order: str, sample: str, least: int, most: int) -> DataFrame:
    """Keys of at least ``least`` rows with their first sample, the ``most`` frequent ones."""
    counted = rows.groupBy(key).agg(F.count("*").alias("copies"), F.min_by(sample, order).alias("sample"))
    return counted.where(F.col("copies") >= least).orderBy(F.desc("copies"), key).limit(most)


def latest_with_tombstones(entries: DataFrame, key: str, sequence: str, kind: str, value: str) -> DataFrame:
    """The last put of each key unless a delete has a larger sequence number; a delete of the same number keeps it."""
    folded = entries.groupBy(key).agg(
        F.max_by(value, F.when(F.col(kind) == "put", F.col(sequence))).alias(value),
        F.max(F.when(F.col(kind) == "put", F.col(sequence))).alias(sequence),
        F.max(F.when(F.col(kind) == "delete", F.col(sequence))).alias("gone"),
    )
    return folded.where(F.col(sequence).isNotNull() & (F.col("gone").isNull() | (F.col("gone") <= F.col(sequence)))).drop("gone")


def upsert_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str, latches: Sequence[str] = ()) -> DataFrame:
    """Merge: the row with the larger version wins, new over old on a tie; ``latches`` stay true once true."""
    both = old.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)))
    plain = [c for c in old.columns if c not in keys and c not in latches]
    folded = both.groupBy(*keys).agg(
        F.max_by(F.struct(*plain), F.struct(version, "is_new")).alias("best"), *[F.bool_or(c).alias(c) for c in latches]
    )
    return folded.select(*[F.col(c) if c in keys or c in latches else F.col(f"best.{c}").alias(c) for c in old.columns])


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows, and new rows whose key is not there yet (one of each key)."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old, list(keys), "left_anti"))


def upsert_protected(old: DataFrame, new: DataFrame, keys: Sequence[str], owner: str, protected: str) -> DataFrame:
    """New rows replace old ones, but for old rows whose ``owner`` is ``protected``; a null owner protects nothing."""
    own = F.col(owner).eqNullSafe(F.lit(protected))
    kept = old.where(own)
    fresh = new.join(kept, list(keys), "left_anti")
    return kept.unionByName(old.where(~own).join(fresh, list(keys), "left_anti")).unionByName(fresh)


def upsert_keep_known(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New values win unless they are null or empty; null keys are equal."""
    values = [c for c in old.columns if c not in keys]
    n, o = new.alias("n"), old.alias("o")
    on = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    both = n.join(o, on, "full_outer")
    known = lambda c: F.when(F.col(f"n.{c}").cast("string") != "", F.col(f"n.{c}"))
    return both.select(*[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys], *[F.coalesce(known(c), F.col(f"o.{c}")).alias(c) for c in values])


def add_totals(old: DataFrame, new: DataFrame, keys: Sequence[str], totals: Sequence[str]) -> DataFrame:
    """Running totals per key."""
    return old.unionByName(new).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in totals])


def replace_children(old: DataFrame, new: DataFrame, parent: Sequence[str]) -> DataFrame:
    """All children of the parents that ``new`` has are replaced by those in ``new``."""
    return old.join(new.select(*parent).distinct(), list(parent), "left_anti").unionByName(new)


def merge_preferring(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of ``first``, and those of ``second`` whose key ``first`` doesn't have."""
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti"))


def prune_absent(old: DataFrame, kept: DataFrame, scope: str, key: str) -> DataFrame:
    """``old`` without the rows of a scope that ``kept`` has rows of, unless their key is among these."""
    scopes = kept.select(scope).distinct()
    swept = old.join(scopes, scope, "left_semi").join(kept.select(scope, key).distinct(), [scope, key], "left_semi")
    return swept.unionByName(old.join(scopes, scope, "left_anti"))


def already_there(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``new`` with ``known``: whether ``old`` has the key, so that its ingestion can be left out."""
    seen = old.select(*keys).distinct().withColumn("known", F.lit(True))
    return new.join(seen, list(keys), "left").withColumn("known", F.coalesce("known", F.lit(False)))


def next_number(parents: DataFrame, children: DataFrame, key: str, number: str) -> DataFrame:
    """For each parent the number after the largest of its children's, 1 without any."""
    largest = children.groupBy(key).agg(F.max(number).alias("largest"))
    return parents.select(key).join(largest, key, "left").select(key, (F.coalesce("largest", F.lit(0)) + 1).alias("next"))


def once_per_content(rows: DataFrame, sha: str, id_col: str) -> DataFrame:
    """The row with the smallest id of each content hash; rows without a hash stand for themselves.

    The keys are prefixed, so an id never meets a hash.
    """
    own = F.coalesce(F.col(sha), F.lit("")) == ""
    key = F.when(own, F.concat(F.lit("id:"), F.col(id_col))).otherwise(F.concat(F.lit("sha:"), F.col(sha)))
    best = rows.groupBy(key.alias("content key")).agg(F.min_by(F.struct(*rows.columns), id_col).alias("best"))
    return best.select("best.*")


def not_in(rows: DataFrame, known: DataFrame, column: str, other: str) -> DataFrame:
    """``rows`` whose ``column`` is NOT IN ``known``, as SQL has it: a null in ``known`` lets no row through, and a null in
    ``column`` only if ``known`` is empty.

    A hashed anti join and two facts about ``known``, of one row; Spark's own null-aware join would be a nested loop.
    """
    facts = known.agg(F.count("*").alias("known rows"), F.count_if(F.col(other).isNull()).alias("known nulls"))
    left = rows.join(known.select(F.col(other).alias(column)), column, "left_anti").join(F.broadcast(facts))
    fits = (F.col("known nulls") == 0) & (F.col(column).isNotNull() | (F.col("known rows") == 0))
    return left.where(fits).select(*rows.columns)


def count_by_allowed(rows: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """(value, n) by a column that a caller names; only those in ``allowed`` may be named."""
    if column not in allowed:
        raise ValueError(f"{column!r} is not one of {', '.join(allowed)}")
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
