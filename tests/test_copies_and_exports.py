"""Copies with new ids against plain loops, and exports that come back whole, or not at all."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from stratalog.operators import export, remap
from stratalog.plans import job_queries

MODULE = "id long, app string, sha string, size long, seen long"


@pytest.fixture(scope="module")
def databases(spark):
    rng = random.Random(5)
    source = [(i, rng.choice(["a", "b", None]), f"s{rng.randint(0, 30)}", i, rng.randint(0, 99)) for i in range(80)] + [(80, None, None, 1, 1), (81, None, None, 2, 2)]
    target = [(900 + i, rng.choice(["a", "b", None]), f"s{i}", -1, 50) for i in range(12)]
    return spark.createDataFrame(source, MODULE), spark.createDataFrame(target, MODULE), source, target


def test_ids(databases):
    source, target, rows, there = databases
    ids = {r.old_id: r.new_id for r in remap.id_map(source, target, "id", ["app", "sha"]).collect()}
    assert set(ids) == {r[0] for r in rows}
    kept = {(r[1], r[2]): r[0] for r in there}
    fresh = sorted({(r[1], r[2]) for r in rows} - set(kept), key=lambda k: [(x is not None, x or "") for x in k])
    want = kept | {k: 912 + n for n, k in enumerate(fresh)}
    assert ids == {r[0]: want[r[1], r[2]] for r in rows}


def test_copy_again_changes_nothing(spark, databases):
    source, target, rows, _ = databases
    ids = remap.id_map(source, target, "id", ["app", "sha"])
    once = remap.copy_parents(source, target, ids, "id", "seen")
    first = sorted(map(tuple, once.collect()), key=str)
    assert len({r[0] for r in first}) == len(first)
    assert {(r[1], r[2]): r[4] for r in first if r[0] < 912}.keys() == {(r[1], r[2]) for r in databases[3]}
    again = remap.id_map(source, once, "id", ["app", "sha"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, ids.collect()))
    assert sorted(map(tuple, remap.copy_parents(source, once, again, "id", "seen").collect()), key=str) == first
    for r in first:  # the newest of all that became this row
        seen = [s[4] for s in rows if (s[1], s[2]) == (r[1], r[2])] + [t[4] for t in databases[3] if t[0] == r[0]]
        assert r[4] == max(seen)


def test_copy_broken_off(databases):
    """A copy that saw half of the source first gives the same ids to what it saw."""
    source, target, _, _ = databases
    half = source.where("id < 40")
    ids = remap.id_map(half, target, "id", ["app", "sha"])
    middle = remap.copy_parents(half, target, ids, "id", "seen")
    later = {r.old_id: r.new_id for r in remap.id_map(source, middle, "id", ["app", "sha"]).collect()}
    assert all(later[r.old_id] == r.new_id for r in ids.collect())


def test_children(spark):
    ids = spark.createDataFrame([(1, 101), (2, 102), (3, 102)], "old_id long, new_id long")
    deps = spark.createDataFrame([(1, "x", 2), (1, "x", 3), (2, "y", 9), (3, "y", None), (7, "z", 1), (1, None, 1), (None, "n", 1)], "from_id long, to_name string, to_id long")
    target = spark.createDataFrame([(102, "y", 5)], deps.schema)
    got = remap.copy_children(deps, target, ids, "from_id", ["from_id", "to_name"], optional=["to_id"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(101, None, 101), (101, "x", 102), (102, "y", 5)], key=str)


def brute_digest(lines, fan):
    level = [hashlib.sha256(x.encode()).hexdigest() for x in lines]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
    return level[0] if level else hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize(("n", "fan"), [(0, 3), (1, 3), (3, 3), (4, 3), (50, 3)])
def test_tree_digest(spark, monkeypatch, n, fan):
    monkeypatch.setattr(export, "FAN", fan)
    lines = [f"line {i * 7 % 13}" for i in range(n)]
    df = spark.createDataFrame(list(enumerate(lines)), "rank long, line string").repartition(4)
    assert export.tree_digest(df, "line") == (brute_digest(lines, fan), n)


SCHEMAS = {"t": "b long, a string, c double", "u": "x int"}
ORDERS = {"t": ["b"], "u": ["x"]}


def tables(spark, parts):
    rows = [(1, "é\"\n", 0.5), (1, None, None), (2, "", 1e30), (None, "x", -0.0), (1, None, None)]
    return {"t": spark.createDataFrame(rows, SCHEMAS["t"]).repartition(parts), "u": spark.createDataFrame([], SCHEMAS["u"])}


def files(path, name):
    return b"".join(p.read_bytes() for p in sorted((path / name).glob("part-*")))


def test_bundle_is_the_same_whatever_the_partitions(spark, tmp_path):
    one = export.write_bundle(tables(spark, 1), ORDERS, f"file://{tmp_path}/1", {"kb_id": "k"})
    four = export.write_bundle(tables(spark, 4), ORDERS, f"file://{tmp_path}/4", {"kb_id": "k"})
    assert one == four and one["counts"] == {"t": 5, "u": 0} and files(tmp_path / "1", "t") == files(tmp_path / "4", "t")
    assert files(tmp_path / "1", "t").decode().splitlines()[0] == '{"a":"x","b":null,"c":-0.0}'
    back = export.read_bundle(spark, f"file://{tmp_path}/1", SCHEMAS, ORDERS)
    assert sorted(map(tuple, back["t"].collect()), key=str) == sorted(map(tuple, tables(spark, 2)["t"].collect()), key=str)


@pytest.mark.parametrize("change", ["line", "lost", "manifest"])
def test_changed_bundle_is_refused(spark, tmp_path, change):
    path = f"file://{tmp_path}/b"
    manifest = export.write_bundle(tables(spark, 1), ORDERS, path)
    for p in (tmp_path / "b").rglob(".*.crc"):
        p.unlink()
    if change == "manifest":
        part = next((tmp_path / "b" / "manifest.json").glob("part-*"))
        part.write_text(part.read_text().replace(manifest["digests"]["t"], "0" * 64))
    else:
        part = next(p for p in (tmp_path / "b" / "t").glob("part-*") if p.stat().st_size)
        text = part.read_text()
        part.write_text(text.replace("1e30", "1e31").replace("1.0E30", "1.0E31").replace('"b":1', '"b":3') if change == "line" else "\n".join(text.splitlines()[1:]) + "\n")
    with pytest.raises(ValueError, match="not"):
        export.read_bundle(spark, path, SCHEMAS, ORDERS)


def test_closure_follows_aliases(spark):
    named = job_queries._tables(spark, "/root/testdata/sf0.001")
    alias = spark.createDataFrame([(1_000_005,)], "kb_id long")
    own = spark.createDataFrame([(5,), (5,)], "kb_id long")
    for latest in (False, True):
        a, b = (export.closure(named, apps, latest) for apps in (alias, own))
        assert set(a) == set(named) == set(ORDERS_OF_NINE)
        for name in a:
            assert sorted(map(tuple, a[name].collect()), key=str) == sorted(map(tuple, b[name].select(a[name].columns).collect()), key=str)
        assert a["kb_apps"].count() == 1 and (not latest or a["knowledge_sources"].count() <= 1)
    assert export.closure(named, own)["kb_diffs"].where(F.col("from_source_id").isNull()).count() == 0


ORDERS_OF_NINE = job_queries.ORDERS


def test_knowledge_folders(spark, tmp_path):
    docs = [("a/b", '{"auth":{"methods":["x"]},"ui":null,"android":{"secrets":[],"native_libs":["l.so"]},"ipc":{}}'), ("c", "broken"), ("d", None), ("e", "{}"), ("f", "[1]")]
    df = spark.createDataFrame(docs, "app string, doc string")
    want = [
        ("a/b", "android/native-libs.json", '["l.so"]'), ("a/b", "auth/methods.json", '["x"]'), ("a/b", "ipc/channels.json", "null"),
        ("a/b", "knowledge.json", '{"android":{"native_libs":["l.so"],"secrets":[]},"auth":{"methods":["x"]},"ipc":{},"ui":null}'), ("e", "knowledge.json", "{}"), ("f", "knowledge.json", "[1]"),
    ]
    assert sorted(map(tuple, export.knowledge_files(df, "app", "doc").collect())) == want
    export.write_knowledge(df.repartition(3), "app", "doc", f"file://{tmp_path}/k")
    back = spark.read.text(f"file://{tmp_path}/k", wholetext=True)
    assert sorted((r.app, r.file, r.value.rstrip("\n")) for r in back.collect()) == want
    assert len(list((tmp_path / "k").rglob("part-*"))) == len(want)
