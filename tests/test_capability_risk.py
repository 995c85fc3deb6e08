"""Risk of capabilities against a plain loop, and cases of floors, caps, pins and multipliers."""

import random

import pytest
from stratalog.operators.capability_risk import Levels, Rubric, capability_risk

NAMES = ["low", "medium", "high", "critical"]
RUBRIC = Rubric(
    weights={"net": 20, "docs": 100, "mic": 30, "zero": 0}, unknown_weight=10, critical_namespaces=("rescap", "uap6"), critical_names=("root",), multipliers={"trusted": 0.5, "unsigned": 1.5, "none": 1.0},
    capped_status="trusted", capped_at="high", pins={"mic": "critical", "net": "medium", "zero": "never"}, namespaces={"windows10/11": "uap6"},
)


def brute(caps, status, r):
    evidence, base, critical, unknown, parts = [] if caps else ["no capabilities"], 0, False, False, []
    for space, name in caps:
        short = next((v for k, v in r.namespaces.items() if space and k in space), space)
        short = short and short.removeprefix("unknown:")
        if short in r.critical_namespaces or name in r.critical_names:
            critical = True
            evidence.append(f"rescap auto-critical: {name}")
            if name in r.weights:
                base += r.weights[name]
                parts.append((name, r.weights[name]))
        elif name in r.weights:
            base += r.weights[name]
            parts.append((name, r.weights[name]))
        else:
            base += r.unknown_weight
            parts.append((name, r.unknown_weight))
            evidence.append(f"unknown_capability:{name}")
            unknown = True
    base = min(max(base, 0), 100)
    if status not in r.multipliers:
        evidence.append(f"unknown signature status: {status}")
    mult = r.multipliers.get(status, 1.0)
    evidence.append(f"{status} multiplier {mult:.1f}")
    value = min(max(int(base * mult), 0), 100)
    level = next(i for i, (_, most) in enumerate(r.levels.steps) if value <= most)
    if critical:
        level = 3
    else:
        if unknown:
            level = max(level, NAMES.index(r.unknown_floor))
        if status == r.capped_status:
            level = min(level, NAMES.index(r.capped_at))
        for _, name in caps:
            pin = r.pins.get(name)
            if pin in NAMES and NAMES.index(pin) > level:
                level = NAMES.index(pin)
                evidence.append(f"level_override:{name}->{pin}")
    evidence += [f"{n} +{w}" for n, w in sorted(parts, key=lambda p: -p[1])[:3]]
    return value, NAMES[level], base, mult, evidence


@pytest.mark.parametrize("seed", range(2))
def test_as_brute_force(spark, seed):
    rng = random.Random(seed)
    apps = [(i, rng.choice(["trusted", "unsigned", "none", "odd"])) for i in range(120)]
    caps = {i: [(rng.choice(["uap", "uap", "uap", "rescap" if rng.random() < 0.2 else "x", "unknown:y", None]), rng.choice(["net", "net", "docs", "mic", "zero", "root" if rng.random() < 0.2 else "net", "new"])) for _ in range(rng.randint(0, 5))] for i, _ in apps}
    rows = [(i, k, s, n) for i, cs in caps.items() for k, (s, n) in enumerate(cs)]
    got = capability_risk(spark.createDataFrame(apps, "id int, status string"), spark.createDataFrame(rows, "id int, place int, space string, name string"), "id", "status", "place", "space", "name", RUBRIC)
    assert {r.id: (r.value, r.level, r.base, r.multiplier, list(r.evidence)) for r in got.collect()} == {i: brute(caps[i], s, RUBRIC) for i, s in apps}


def test_namespaces_fold(spark):
    rows = [(1, 0, "unknown:http://schemas/appx/windows10/11", "net"), (2, 0, "unknown:rescap", "net"), (3, 0, "windows10/10", "net")]
    apps = spark.createDataFrame([(1, "none"), (2, "none"), (3, "none")], "id int, status string")
    got = capability_risk(apps, spark.createDataFrame(rows, "id int, place int, space string, name string"), "id", "status", "place", "space", "name", RUBRIC)
    assert {r.id: r.level for r in got.collect()} == {1: "critical", 2: "critical", 3: "medium"}


def test_levels_are_an_ordered_set(spark):
    from pyspark.sql import functions as F

    levels = Levels()
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(levels.name(levels.of(F.lit(v)))) for v in (0, 24, 25, 49, 50, 74, 75, 100, 900)] == ["low", "low", "medium", "medium", "high", "high", "critical", "critical", "critical"]
    at = lambda n: F.lit(NAMES.index(n))
    assert [one(levels.at_least(at("medium"), f)) for f in ("low", "high", "none")] == [1, 2, 1]
    assert [one(levels.at_most(at("high"), c)) for c in ("low", "critical", "none")] == [0, 2, 2]
