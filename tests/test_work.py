"""Ranks and running sums over range partitions, and tables that are written and forgotten."""

import os
import random

from pyspark.sql import functions as F
from stratalog.operators.work import forget, running, scratch, shared_dir, written


def test_running(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.randint(0, 5), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, n int, i int, w int").repartition(7)
    got = running(df, ["k", F.desc("n"), "i"], ["w"]).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", -r[1], r[2]))
    total = 0
    for rank, (r, w) in enumerate(zip(sorted(got, key=lambda r: r["rank"]), want, strict=True)):
        assert r["rank"] == rank and (r.k, r.n, r.i, r.w) == w and r.w_before == total
        total += r.w
    assert running(df.limit(0), ["k"], ["w"]).collect() == []


def test_scratch_forgets(spark):
    folder = shared_dir(spark).removeprefix("file:")
    there = lambda: {n for n in os.listdir(folder) if n.startswith("mine-")}
    with scratch():
        table = written(spark.range(5), "mine")
        kept = written(spark.range(3), "mine", keep=True)
        assert table.count() == 5 and len(there()) == 2
    assert len(there()) == 1 and kept.count() == 3
    forget(kept)
    forget(kept)
    assert not there()
