"""The bundle splitter: cases of bundle scans, its bounds, and plain searching on random bundles."""

import random

import pytest
from pyspark.sql import functions as F
from stratalog.functions import shapes
from stratalog.operators import bundles


def split(spark, rows):
    df = spark.createDataFrame(rows, "bundle string, app string, body string")
    return sorted(map(tuple, bundles.split_bundles(df, "bundle", "app", "body").collect()))


def test_named(spark):
    body = '__d("WAWebMsgCollection",function(){return 1;});__d("WAWebChat",function(){return 2;});'
    assert split(spark, [("b", "wa", body), ("none", "wa", "var a = 1;"), ("null", "wa", None), ("empty", "wa", "")]) == [
        ("b", "named", "WAWebChat", 53, 34), ("b", "named", "WAWebMsgCollection", 5, 43),
    ]


def test_numbered(spark):
    rows = [
        ("f", "teams", "{12345:function(e,t,n){return 1;},67890:function(){return 2;}}"), ("a", "slack", "{42:(e,t,n)=>{return 1;}}"),
        ("x", "x", "{1:42,2:e=>e+1,3:[1],4:'s',55:function}"), ("nulls", None, "{9:e=>{}}"),
    ]
    assert split(spark, rows) == [
        ("a", "numbered", "slack_module_42", 4, 22), ("f", "numbered", "teams_module_12345", 7, 27), ("f", "numbered", "teams_module_67890", 40, 23),
        ("nulls", "numbered", "_module_9", 3, 7), ("x", "numbered", "x_module_2", 8, 7), ("x", "numbered", "x_module_55", 30, 10),
    ]


def test_bounds():
    long_name, just = b"n" * 257, b"n" * 256
    body = b'__d("' + long_name + b'",1);__d("' + just + b'",2);__d("open'
    assert [(len(n), o) for n, o, _ in bundles.named_modules(body)] == [(256, 5 + 257 + 5 + 5)]
    assert next(bundles.named_modules(b'__d("a",' + b"x" * (2 << 20)))[2] == 1 << 20
    assert next(bundles.numbered_modules(b"{1:e=>" + b"x" * (2 << 20), "p"))[2] == 1 << 20
    arrow = lambda n: list(bundles.numbered_modules(b"{1:(" + b"a" * n + b")=>{}}", "p"))
    assert arrow(60) and not arrow(61)
    single = lambda n: list(bundles.numbered_modules(b"{1:" + b"a" * n + b"=>{}}", "p"))
    assert single(30) and not single(31)
    assert not list(bundles.numbered_modules(b"{1:a=>", "p")) and list(bundles.numbered_modules(b"{1:a=>b", "p"))


def plain_numbered(body, app):
    """Byte by byte."""
    n, at, out = len(body), 0, []
    begins = []
    while at < n:
        end = at + 1
        while end < n and body[end : end + 1].isdigit():
            end += 1
        if body[at : at + 1] in (b"{", b",") and end > at + 1 and body[end : end + 1] == b":":
            begins.append((at, end))
            at = end
        at += 1
    for k, (start, colon) in enumerate(begins):
        rest = body[colon + 1 :]
        factory = rest[:8] == b"function" and len(rest) > 8
        if not factory and rest[:1] == b"(":
            factory = b")=>" in rest[:64]
        elif not factory and rest[:1].islower() and len(rest) > 3:
            factory = b"=>" in rest[:32]
        if factory:
            stop = begins[k + 1][0] if k + 1 < len(begins) else n
            out.append((f"{app}_module_{body[start + 1 : colon].decode()}", colon + 1, min(stop - colon, 1 << 20)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_random_bundles(seed):
    rng = random.Random(seed)
    parts = [b"{", b",", b"1", b"23", b":", b"function", b"(", b")=>", b"e", b"=>", b"x" * 20, b" ", b"}", b"(e,t)=>{", b",7:function(){", b'__d("N",']
    for _ in range(300):
        body = b"".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert list(bundles.numbered_modules(body, "p")) == plain_numbered(body, "p"), body


def test_prefix_and_body(spark):
    names = ["foo", "WAWeb", "WAWebMsgCollection", "WAWebChat", "WAWebX", "xWAWebChat"]
    got = [r.p for r in spark.createDataFrame([(n,) for n in names], "n string").select(bundles.name_prefix(F.col("n")).alias("p")).collect()]
    assert got == ["", "WAWeb", "WAWebMsg", "WAWebChat", "WAWebX", ""]
    row = spark.createDataFrame([(bytearray(b"XXXXhello worldYYYY"), 4, 11)], "b binary, o long, s long")
    assert [bytes(row.select(bundles.module_body(F.col("b"), F.col("o"), F.col("s"), most)).first()[0]) for most in (100, 5)] == [b"hello world", b"hello"]


def test_recovered(spark, tmp_path):
    for name, manifest in (("a", '{"bundle_kind":"webpack","n":1}'), ("b", '{"bundle_kind":"Vite"}'), ("c", "not json"), ("d", None), ("e", '{"bundle_kind":"other"}')):
        (tmp_path / name / "modules" / "deep").mkdir(parents=True)
        (tmp_path / name / "modules" / "deep" / "one.js").write_text("12345")
        (tmp_path / name / "modules" / "Two.JS").write_text("1")
        (tmp_path / name / "modules" / "note.txt").write_text("1")
        if manifest is not None:
            (tmp_path / name / "manifest.json").write_text(manifest)
    got = bundles.recovered_modules(spark, f"file://{tmp_path}").collect()
    quality = {"a": "recovered_webpack", "b": "recovered_vite", "c": "raw", "d": "raw", "e": "raw"}
    assert sorted((r.bundle[-1], r.name, r["size"], r.name_quality) for r in got) == sorted((b, n, s, q) for b, q in quality.items() for n, s in (("one", 5), ("Two", 1)))


def test_modules_by_name_in_one_pass(spark):
    """Large bundles, odd ones, and offsets that need no array of all lengths for each module."""
    calls = [f'__d("C{i}",function(){{{"é" * (i % 5)}}});' for i in range(3000)]
    texts = {"big": "var a;" + "".join(calls), "none": "var b;", "open": 'x__d("never ends', "two": '__d("A",1)__d("B")', "null": None}
    df = spark.createDataFrame([(k, 1, v) for k, v in texts.items()], "name_of string, n int, body string")
    found = shapes.modules_by_name(df, ["name_of", "n"], "body")
    want = []
    for k, text in texts.items():
        at = 0
        for i, part in enumerate((text or "").split('__d("')):
            if i and '"' in part:
                want.append((k, 1, part.split('"')[0], at, len(part)))
            at += len(part) + 5
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) == 3002
    assert [f.dataType.simpleString() for f in found.schema.fields[3:]] == ["int", "int"]
    assert "array_append" not in found._jdf.queryExecution().optimizedPlan().toString()
