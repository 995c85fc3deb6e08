"""Shards as runs of a Hilbert curve through several metadata dimensions.

Rows that are near each other in all dimensions get near curve indexes, so a shard covers a compact box and its
min/max statistics let a reader skip it for a filter on any of the dimensions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import running, written


def _rotate_left(x: int, by: int, n: int) -> int:
    by %= n
    return ((x << by) | (x >> (n - by))) & ((1 << n) - 1)


def _gray(i: int) -> int:
    return i ^ (i >> 1)


def _trailing_ones(i: int) -> int:
    return (~i & (i + 1)).bit_length() - 1


def curve_steps(dims: int) -> list[tuple[int, int]]:
    """The curve as an automaton: (digit, next state) at place state * 2**dims + label.

    A state is an entry corner and a direction; the label holds one bit of each coordinate.
    """
    size, inverse = 1 << dims, {_gray(i): i for i in range(1 << dims)}
    entry = [0] + [_gray(2 * ((w - 1) // 2)) for w in range(1, size)]
    turn = [0] + [_trailing_ones(w - 1 if w % 2 == 0 else w) % dims for w in range(1, size)]
    steps = []
    for state in range(size * dims):
        corner, direction = divmod(state, dims)
        for label in range(size):
            w = inverse[_rotate_left(label ^ corner, dims - (direction + 1) % dims, dims)]
            to = corner ^ _rotate_left(entry[w], direction + 1, dims)
            steps.append((w, to * dims + (direction + turn[w] + 1) % dims))
    return steps


def hilbert_index(coordinates: Sequence[Column], bits: int) -> Column:
    """Curve index of non-negative integer coordinates below 2**bits, as long."""
    dims = len(coordinates)
    steps = curve_steps(dims)
    digits = F.array(*[F.lit(w) for w, _ in steps])
    states = F.array(*[F.lit(s) for _, s in steps])

    def step(acc: Column, level: Column) -> Column:
        label = sum(
            (F.call_function("shiftright", c.cast("int"), level).bitwiseAND(F.lit(1)) * F.lit(1 << d) for d, c in enumerate(coordinates)),
            F.lit(0),
        )
        at = acc.state * F.lit(1 << dims) + label
        return F.struct(
            F.get(states, at).alias("state"),
            (acc.index * F.lit(1 << dims) + F.get(digits, at)).cast("long").alias("index"),
        )

    return F.aggregate(
        F.array(*[F.lit(i) for i in range(bits - 1, -1, -1)]),
        F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index")),
        step,
        lambda acc: acc.index,
    )


def _as_number(df: DataFrame, dims: Sequence[str]) -> dict[str, Column]:
    """Each dimension as a double in its own order; strings by the six bytes after their common beginning."""
    kinds = dict(df.dtypes)
    texts = [d for d in dims if kinds[d] == "string"]
    common = {d: 0 for d in texts}
    if texts:
        ends = df.agg(*[f(d).alias(f"{n}_{i}") for i, d in enumerate(texts) for n, f in (("lo", F.min), ("hi", F.max))]).first()
        for i, d in enumerate(texts):
            lo, hi = ((ends[f"{n}_{i}"] or "").encode() for n in ("lo", "hi"))
            common[d] = next((k for k, (a, b) in enumerate(zip(lo, hi, strict=False)) if a != b), min(len(lo), len(hi)))
    return {
        d: F.conv(F.rpad(F.hex(F.substr(F.encode(F.col(d), "UTF-8"), F.lit(common[d] + 1), F.lit(6))), 12, "0"), 16, 10).cast("double")
        if d in common
        else F.col(d).cast("double")
        for d in dims
    }


def hilbert_shards(
    rows: DataFrame, dims: Sequence[str], ties: Sequence[str], shards: int = 16, bits: int = 4, keep: Sequence[str] = ()
) -> DataFrame:
    """Number the rows along the curve and cut the numbering into runs whose row counts differ by one at most.

    Each dimension is quantised into 2**bits cells at its own quantiles, so that skewed values use the whole
    curve; null lies in the lowest cell. Rows of one cell are ordered by ``ties``; rows equal in all of them are
    interchangeable. Returns ``keep``, the curve index ``cell``, ``shard`` from 0 and ``slot``, gapless from 0; columns
    that are kept must have other names than these. Repeated rows are rows of their own, and equal texts have no bond: under
    a law of equal counts the border of a run can fall between rows that are equal in everything but their ids. Texts take
    no part but by what the caller makes of them, so their length is no matter. An empty table gives an empty table.

    The sort is one range shuffle of the kept columns, which holds no text of any length; row numbers then come from
    each partition's count.
    """
    numbers = _as_number(rows, dims)
    levels = 1 << bits
    cuts = rows.agg(
        *[F.percentile_approx(numbers[d], [k / levels for k in range(1, levels)], 1000).alias(f"c{i}") for i, d in enumerate(dims)]
    ).first()
    cells = [
        F.coalesce(F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts[i]]), lambda c, v=numbers[d]: c <= v)), F.lit(0))
        if cuts[i]
        else F.lit(0)
        for i, d in enumerate(dims)
    ]
    key = ["cell", *ties]
    # Written before the sort, as drawing range bounds reads its input once more: texts behind it are read once.
    along = written(rows.withColumn("cell", hilbert_index(cells, bits)).select(*dict.fromkeys([*keep, *key])), "cells")
    total = along.count()
    ranked = running(along, key)
    shard = F.expr(f"(rank * {shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard.cast("int")).select(
        *[c for c in along.columns if c in keep or c == "cell"], "shard", (F.col("rank") - first).cast("long").alias("slot")
    )


def write_shards(rows: DataFrame, path: str) -> None:
    """Write rows that carry ``shard`` and ``slot`` as one folder per shard, each in the order of the slots.

    Every shard is dealt over the range of its slots, so that a shard is several files of bounded size.
    """
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
