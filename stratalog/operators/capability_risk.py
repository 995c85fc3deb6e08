"""Risk of capabilities: weights, a signature's multiplier, and levels as an ordered set with floors, caps and pins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Capabilities that a trace names.
TRACED = 3


@dataclass(frozen=True)
class Levels:
    """Levels from the lowest, each with the highest value that it has."""

    steps: tuple[tuple[str, int], ...] = (("low", 24), ("medium", 49), ("high", 74), ("critical", 100))

    def rank(self, name: str | None) -> int | None:
        """The place of a level from 0; null for none of these."""
        return next((i for i, (n, _) in enumerate(self.steps) if n == name), None)

    def name(self, rank: Column) -> Column:
        return F.get(F.array(*[F.lit(n) for n, _ in self.steps]), rank)

    def of(self, value: Column) -> Column:
        """The rank of the lowest level that holds the value, else of the highest."""
        out = F.lit(len(self.steps) - 1)
        for i, (_, most) in reversed(list(enumerate(self.steps))):
            out = F.when(value <= most, i).otherwise(out)
        return out

    def at_least(self, rank: Column, floor: str | None) -> Column:
        """The higher of both; an unknown floor changes nothing."""
        at = self.rank(floor)
        return rank if at is None else F.greatest(rank, F.lit(at))

    def at_most(self, rank: Column, ceiling: str | None) -> Column:
        """The lower of both; an unknown ceiling changes nothing."""
        at = self.rank(ceiling)
        return rank if at is None else F.least(rank, F.lit(at))


@dataclass(frozen=True)
class Rubric:
    """Weights of capabilities and what moves levels; every table is a parameter."""

    weights: Mapping[str, int]
    unknown_weight: int = 10
    unknown_floor: str | None = "high"
    critical_namespaces: Sequence[str] = ()
    critical_names: Sequence[str] = ()
    multipliers: Mapping[str, float] = field(default_factory=dict)
    capped_status: str | None = None  # a signature that caps the level
    capped_at: str | None = "high"
    pins: Mapping[str, str] = field(default_factory=dict)  # capability -> level that it asks for at least
    namespaces: Mapping[str, str] = field(default_factory=dict)  # part of a namespace -> its short name
    levels: Levels = field(default_factory=Levels)


def _looked_up(table: Mapping, key: Column, kind: str) -> Column:
    if not table:
        return F.lit(None).cast(kind)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key).cast(kind)


def capability_risk(apps: DataFrame, capabilities: DataFrame, id_col: str, status: str, place: str, namespace: str, name: str, rubric: Rubric) -> DataFrame:
    """id, value, level, base, multiplier and evidence of every row of ``apps`` (id, signature status).

    ``capabilities`` has their namespaces and names in the order of ``place``. The base is the sum of weights, within 0 and
    100; unknown capabilities weigh ``unknown_weight`` and lift the level to ``unknown_floor``. The signature multiplies the
    base. Critical namespaces and names make the level critical, whatever else; without one, the capped signature caps
    it, and then pins lift it again. The evidence lists, in order: critical and unknown capabilities, the signature, the pins
    that lifted the level, and the TRACED weightiest capabilities.

    Sums and flags are combined before the shuffle; only capabilities that evidence can name are listed.
    """
    r, levels = rubric, rubric.levels
    short = F.col(namespace)
    for part, known in reversed(list(r.namespaces.items())):
        short = F.when(F.contains(F.col(namespace), F.lit(part)), known).otherwise(short)
    short = F.regexp_replace(short, "^(unknown:)+", "")
    critical = F.coalesce(short.isin(*r.critical_namespaces), F.lit(False)) | F.coalesce(F.col(name).isin(*r.critical_names), F.lit(False))
    weight = _looked_up(r.weights, F.col(name), "int")
    pin = _looked_up({k: levels.rank(v) for k, v in r.pins.items() if levels.rank(v) is not None}, F.col(name), "int")
    own = capabilities.select(F.col(id_col), F.col(place).alias("at"), F.col(name).alias("cap"), critical.alias("critical"), weight.alias("weight"), pin.alias("pin"))
    own = own.withColumn("unknown", ~F.col("critical") & F.col("weight").isNull())
    own = own.withColumn("counts", F.when(F.col("unknown"), r.unknown_weight).otherwise(F.col("weight")))
    said = F.when(F.col("critical"), F.concat(F.lit("rescap auto-critical: "), F.coalesce("cap", F.lit("")))).when(F.col("unknown"), F.concat(F.lit("unknown_capability:"), F.coalesce("cap", F.lit(""))))
    ordered = lambda what, if_: F.sort_array(F.collect_list(F.when(if_, F.struct("at", what.alias("x")))))
    trace = F.when(F.col("counts").isNotNull(), F.struct((-F.col("counts")).alias("w"), "at", F.concat("cap", F.lit(" +"), "counts").alias("x")))
    per = own.groupBy(id_col).agg(
        F.sum("counts").alias("sum"),
        F.bool_or("critical").alias("critical"),
        F.bool_or("unknown").alias("unknown"),
        F.count("*").alias("n"),
        ordered(said, said.isNotNull()).alias("said"),
        ordered(F.struct("cap", "pin"), F.col("pin").isNotNull()).alias("pinned"),
        F.slice(F.sort_array(F.collect_list(trace)), 1, TRACED).alias("trace"),
    )
    both = apps.select(F.col(id_col), F.col(status).alias("status")).join(per, id_col, "left")
    known = _looked_up(r.multipliers, F.col("status"), "double")
    base = F.least(F.greatest(F.coalesce("sum", F.lit(0)), F.lit(0)), F.lit(100)).cast("int")
    both = both.select("*", base.alias("base"), F.coalesce(known, F.lit(1.0)).alias("multiplier"), known.isNull().alias("unsigned"))
    both = both.withColumn("value", F.least(F.greatest((F.col("base") * F.col("multiplier")).cast("int"), F.lit(0)), F.lit(100)))
    rank = levels.of(F.col("value"))
    rank = F.when(F.coalesce("unknown", F.lit(False)), levels.at_least(rank, r.unknown_floor)).otherwise(rank)
    if r.capped_status is not None:
        rank = F.when(F.col("status") == r.capped_status, levels.at_most(rank, r.capped_at)).otherwise(rank)
    both = both.withColumn("rank", rank)
    start = F.struct(F.col("rank").cast("int").alias("rank"), F.array().cast("array<string>").alias("said"))
    lift = lambda s, p: F.when(p["x"]["pin"] > s["rank"], F.struct(p["x"]["pin"].alias("rank"), F.array_append(s["said"], F.concat(F.lit("level_override:"), p["x"]["cap"], F.lit("->"), levels.name(p["x"]["pin"]))).alias("said"))).otherwise(s)
    lifted = F.aggregate(F.coalesce("pinned", F.array().cast(dict(per.dtypes)["pinned"])), start, lift)
    both = both.withColumn("lifted", F.when(F.coalesce("critical", F.lit(False)), F.struct(F.lit(len(levels.steps) - 1).alias("rank"), F.array().cast("array<string>").alias("said"))).otherwise(lifted))
    texts = lambda c: F.transform(F.coalesce(c, F.array().cast(dict(per.dtypes)[c])), lambda s: s["x"])
    one = lambda if_, text: F.when(if_, F.array(text)).otherwise(F.array().cast("array<string>"))
    signed = F.format_string("%s multiplier %.1f", F.coalesce("status", F.lit("")), F.col("multiplier"))
    evidence = F.concat(
        one(F.coalesce("n", F.lit(0)) == 0, F.lit("no capabilities")), texts("said"), one(F.col("unsigned"), F.concat(F.lit("unknown signature status: "), F.coalesce("status", F.lit("")))),
        F.array(signed), F.col("lifted.said"), texts("trace"),
    )
    return both.select(id_col, "value", levels.name(F.col("lifted.rank")).alias("level"), "base", "multiplier", evidence.alias("evidence"))
