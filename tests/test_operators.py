import json
import random

import pytest
from pyspark.sql import functions as F
from stratalog.functions import score as S
from stratalog.functions import text as X
from stratalog.functions.canonical import canonical_hash
from stratalog.operators import changes, events, graph, keys, matching, search, texts
from stratalog.sources import files
from stratalog.sources.tables import export_jsonl, import_jsonl


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_tombstones(spark):
    rows = [("a", 1, "put", "x"), ("a", 3, "put", "y"), ("a", 2, "delete", None), ("b", 1, "put", "x"), ("b", 2, "delete", None), ("c", 2, "put", "z"), ("c", 2, "delete", None), ("d", 1, "metadata", "m")]
    df = spark.createDataFrame(rows, "key string, sequence long, type string, value string")
    assert values(keys.latest_with_tombstones(df, "key", "sequence", "type", "value").select("key", "value")) == [("a", "y"), ("c", "z")]


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([(1, 5, "old", False), (2, 9, "stays", True)], "k int, version int, v string, flag boolean")
    new = spark.createDataFrame([(1, 6, "new", True), (2, 3, "late", False), (3, 1, "first", False)], "k int, version int, v string, flag boolean")
    once = keys.upsert_latest(old, new, ["k"], "version", ["flag"])
    assert values(once) == [(1, 6, "new", True), (2, 9, "stays", True), (3, 1, "first", False)]
    assert values(keys.upsert_latest(once, new, ["k"], "version", ["flag"])) == values(once)
    assert values(keys.insert_missing(old, new, ["k"])) == [(1, 5, "old", False), (2, 9, "stays", True), (3, 1, "first", False)]


def test_other_merges(spark):
    old = spark.createDataFrame([(1, "manual", "a"), (2, "rule", "b")], "k int, owner string, v string")
    new = spark.createDataFrame([(1, "rule", "x"), (2, "rule", "y"), (3, "rule", "z")], "k int, owner string, v string")
    assert values(keys.upsert_protected(old, new, ["k"], "owner", "manual")) == [(1, "manual", "a"), (2, "rule", "y"), (3, "rule", "z")]
    gaps = spark.createDataFrame([(1, None, ""), (2, "", "q")], "k int, owner string, v string")
    assert values(keys.upsert_keep_known(old, gaps, ["k"])) == [(1, "manual", "a"), (2, "rule", "q")]
    totals = spark.createDataFrame([("r", 2), ("s", 3)], "k string, n long")
    assert values(keys.add_totals(totals, totals, ["k"], ["n"])) == [("r", 4), ("s", 6)]
    children = spark.createDataFrame([("p", 1), ("p", 2), ("q", 3)], "parent string, c int")
    assert values(keys.replace_children(children, children.where("c = 1").withColumn("c", F.lit(9)), ["parent"])) == [("p", 9), ("q", 3)]


def test_fact_diff_of_equal_and_swapped_sides(spark):
    a = spark.createDataFrame([("k1", "1"), ("k2", None), ("k3", "3")], "key string, value string")
    b = spark.createDataFrame([("k1", "2"), ("k2", None), ("k4", "4")], "key string, value string")
    assert values(changes.fact_diff(a, a, ["key"], "value")) == []
    got = {r.key: r.change_type for r in changes.fact_diff(a, b, ["key"], "value").collect()}
    back = {r.key: r.change_type for r in changes.fact_diff(b, a, ["key"], "value").collect()}
    assert got == {"k1": "modified", "k3": "removed", "k4": "added"}
    assert back == {"k1": "modified", "k3": "added", "k4": "removed"}


def test_quantiles_by_index(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "jumps long")
    row = events.index_quantiles(df, "jumps", {"median": 0.5, "p95": 0.95}).first()
    assert (row["median"], row["p95"], row["max"]) == (3, 4, 4)
    rng = random.Random(1)
    many = [rng.randint(0, 30) for _ in range(501)]
    row = events.index_quantiles(spark.createDataFrame([(x,) for x in many], "jumps long"), "jumps", {"median": 0.5, "p95": 0.95}).first()
    assert (row["median"], row["p95"]) == (sorted(many)[250], sorted(many)[int(501 * 0.95)])


def test_version_ranges(spark):
    ranges = spark.createDataFrame([("A", 0, 12006), ("B", 12100, None), ("C", 11900, 11904)], "vuln string, lo int, hi int").withColumn("c", F.lit("go"))
    rows = spark.createDataFrame([("go", 12003), ("go", 12006), ("go", 12200)], "c string, v int")
    found = matching.in_range(rows, ranges, ["c"], F.col("v"), "lo", "hi", "vuln")
    assert values(found.select("v", "vuln")) == [(12003, "A"), (12200, "B")]


def test_scores(spark):
    one = spark.range(1)
    s = lambda c: one.select(c.alias("x")).first().x
    assert s(S.relative_delta(F.lit(0.02), F.lit(0.001))) == pytest.approx(1.9)
    assert [s(S.risk_level(F.lit(v))) for v in (24, 25, 50, 75)] == ["low", "medium", "high", "critical"]
    assert [s(S.threat_level(F.lit(v))) for v in (0, 1, 40, 100, 200)] == ["CLEAN", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
    assert s(S.cvss3_base_score(F.lit("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"))) == 9.8
    assert s(S.cvss3_base_score(F.lit("CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N"))) == 6.1
    assert tuple(s(S.outdated_by(F.lit("v1.2.9"), F.lit("1.4.1")))) == (0, 2, 0)
    assert s(S.outdated_by(F.lit("v1.2.9-rc1"), F.lit("1.4.1"))) is None
    assert s(S.index_quantile(F.sort_array(F.array(F.lit(4), F.lit(1), F.lit(3), F.lit(2))), 0.5)) == 3
    assert [s(S.hamming_severity(F.lit(d))) for d in (5, 12, 13)] == ["PASS", "FLAG", "BLOCK"]


def test_similarity_and_names(spark):
    one = spark.range(1)
    s = lambda c: one.select(c.alias("x")).first().x
    assert s(X.trigram_similarity(F.lit("foo bar"), F.lit("foobar"))) == 0.5
    assert s(X.trigram_similarity(F.lit("Same Text"), F.lit("same text"))) == 1.0
    assert s(X.trigram_similarity(F.lit(""), F.lit(""))) == 0.0
    assert s(X.slug(F.lit("  Some App (v2)!"))) == "some-app-v2"
    assert s(X.summary_line(F.lit("s"), F.lit("r"), F.lit("t"))) == "[r] s {t}"
    assert s(X.display_name(F.lit("teams_module_7"), F.lit("Chat"))) == "Chat" and s(X.display_name(F.lit("0123456789ab"), F.lit("Chat"))) == "0123456789ab"
    assert s(X.error_class(F.lit("rpc: context deadline exceeded"))) == "timeout"


def test_search_leaves_bodies_out(spark):
    rows = spark.createDataFrame([(1, "WAWebMsg", "message store", "crypto"), (2, "Presence", None, None)], "id int, name string, summary string, tags string")
    hit = lambda q: [r.id for r in search.search(rows, q, "id", "name", "summary", ["name", "summary", "tags"]).collect()]
    assert hit("crypto") == [1] and hit("presence") == [2] and hit("fetch(") == []


def test_pages_follow_each_other(spark):
    rows = spark.createDataFrame([(i, f"alpha beta {'x' * (i % 3)}", i % 2) for i in range(30)], "id int, t string, at int")
    whole = search.similar_page(rows, "alpha beta", "t", "at", "id", 30, least=0.1).collect()
    last, seen = None, []
    while page := search.similar_page(rows, "alpha beta", "t", "at", "id", 7, after=last, least=0.1).collect():
        seen += page
        last = (page[-1].similarity, page[-1].at, page[-1].id)
    assert seen == whole and len(seen) == 30


def test_fallback_only_when_empty(spark):
    a, b = spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(2,)], "id int")
    assert [r.id for r in search.with_fallback(a, b, "id", 5).collect()] == [1]
    assert [r.id for r in search.with_fallback(a.limit(0), b, "id", 5).collect()] == [2]


def test_near_names_as_all_pairs(spark):
    rng = random.Random(7)
    names = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(60)})
    known = names[::5]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(before, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(before[j] + 1, out[-1] + 1, before[j - 1] + (x != y)))
        return out

    want = {}
    for a in names:
        best = min(((distance(a, k), k) for k in known if k != a and distance(a, k) <= 2), default=None)
        if best:
            want[a] = best
    df = spark.createDataFrame([(n,) for n in names], "name string")
    pop = spark.createDataFrame([(n,) for n in known], "known string")
    got = {r.name: (r.distance, r.known) for r in matching.near_names(df, pop, "name", "known", 2).collect()}
    assert got == want


def test_near_names_of_one_beginning(spark):
    """Names that share all but their last digits meet those near them, not all; long ones, accents and repeats too."""
    names = [f"Supplier#{i:09d}" for i in range(600)] + ["n" * 5000, "n" * 4999 + "m", "n" * 4998, "é", "éa", "", "b", None, "b"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    pop = spark.createDataFrame([(n,) for n in [*names[:600:10], "n" * 5000, "é", "", None, ""]], "known string")
    got = matching.near_names(df, pop, "name", "known", 1)
    found = {r.name: (r.known, r.distance) for r in got.collect()}
    want = {}
    for i in range(600):
        near = [k for k in range(0, 600, 10) if sum(a != b for a, b in zip(f"{i:03d}", f"{k:03d}", strict=True)) == 1]
        if near:
            want[names[i]] = (names[min(near)], 1)
    want |= {"n" * 4999 + "m": ("n" * 5000, 1), "éa": ("é", 1), "é": ("", 1), "b": ("", 1), "": ("é", 1)}
    assert found == want and got.count() == len(want)
    joined = got._jdf.queryExecution().optimizedPlan().toString()
    assert "left of it" in joined
    assert matching.near_names(df, pop, "name", "known", 0).isEmpty()


def test_component_rules(spark):
    rules = spark.createDataFrame([("auth", "login", 0.9, 1, False), ("ui", "render", 0.9, 1, False), ("ui", "mock", 0.1, 9, True)], "component string, pattern string, confidence double, priority int, suppress boolean")
    rows = spark.createDataFrame([(1, "LOGIN page"), (2, "login render"), (3, "login render mock"), (4, ""), (5, None)], "id int, t string")
    got = {r.id: (r.component, r.confidence) for r in texts.apply_rules(rows, rules, "id", "t").collect()}
    assert got == {1: ("auth", 0.9), 2: ("other", 1.0), 3: ("auth", 0.9), 4: ("other", 1.0), 5: ("other", 1.0)}


def brute_component(rules, text, path, name):
    import re

    def fits(r):
        words = [r.keyword] if isinstance(r.keyword, str) else list(r.keyword or ())
        parts = [any(w.lower() in text.lower() for w in words)] if words else []
        parts += [bool(re.search(r.path, path))] if r.path else []
        parts += [bool(re.search(r.name, name))] if r.name else []
        return bool(parts) and all(parts)

    gone = {r.component for r in rules if r.suppress and fits(r)}
    found = sorted((r for r in rules if not r.suppress and r.component not in gone and fits(r)), key=lambda r: (-r.confidence, r.priority))
    if not found:
        return "other", 1.0
    if len(found) > 1 and (found[0].confidence, found[0].priority) == (found[1].confidence, found[1].priority) and found[0].component != found[1].component:
        return "other", 1.0
    return found[0].component, found[0].confidence


@pytest.mark.parametrize("seed", range(4))
def test_component_rules_as_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "delta"]
    part = lambda: rng.choice([None, None, "^a", "b$"])
    rules = [
        texts.ComponentRule(rng.choice("xyz"), rng.choice([0.5, 0.9]), rng.choice([1, 2]), keyword=rng.choice([None, "alpha", ("Beta", "gamma"), ("delta",)]), path=part(), name=part(), suppress=rng.random() < 0.2)
        for _ in range(rng.randint(0, 9))
    ]
    rows = [(i, " ".join(rng.sample(words, rng.randint(0, 4))), rng.choice(["ab", "b", "a"]), rng.choice(["ab", "c"])) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, t string, p string, n string").withColumn("hits", F.lit("mine")).withColumn("component", F.lit("old"))
    got = texts.with_component(df, rules, F.col("t"), F.col("p"), F.col("n")).collect()
    want = {i: brute_component(rules, t, p, n) for i, t, p, n in rows}
    assert {r.id: (r.component, r.confidence) for r in got} == want and all(r.hits == "mine" for r in got)


def test_noise(spark):
    clean = ['{"methods":["run"]}', '{"urls":["while"]}', '{"a":{"x":1},"methods":["run"]}', '{"n":3,"methods":["run"]}', '{"methods":["run",null]}', '{"a":{}}', '{"a":[1]}', '{"methods":["a[b]"]}', '{"a":"[a-z]"}']
    noisy = ["", "  ", None, "no json", "[]", "{}", "null", '{"methods":["While"]}', '{"types":["go"]}', '{"urls":["[a-z]"]}', '{"x":["[^0-9]"],"methods":["run"]}', '{"methods":[],"urls":[]}', '{"methods":null}', '{"a":1,"functions":["return"]}']
    df = spark.createDataFrame([(s, w) for w, xs in ((False, clean), (True, noisy)) for s in xs], "s string, want boolean")
    assert [r.s for r in df.where(S.is_noise(F.col("s")) != F.col("want")).collect()] == []


def test_minified(spark):
    cases = [("x" * 3000, True), ("x" * 511, False), ("x" * 1999, False), ("x" * 2000, True), ("a\n" * 50 + "x" * 3000, False), ("a\n" + "x" * 3000, True), ("é" * 1000, True), ("é" * 999, False), (None, False), ("", False), ("ok\n" * 30000 + "x" * 5000, False)]
    df = spark.createDataFrame(cases, "t string, want boolean")
    assert df.where(X.looks_minified(F.col("t")) != F.col("want")).count() == 0


def test_scoped_imports(spark):
    yes = ["require('@a/b')", 'from "@scope/pkg"', "import  '@x/y-z/w'", "from\t'@a.b/c'"]
    no = ["require('@A/b')", "import('@a/b')", "from '@a/b", "require( '@a/b')", "from'@a/b'", "'@a/b'"]
    df = spark.createDataFrame([(s, w) for w, xs in ((True, yes), (False, no)) for s in xs], "s string, want boolean")
    assert df.where(texts.is_vendored(F.col("s")) != F.col("want")).count() == 0


def test_ranking_within_budget(spark):
    rows = [(1, 5, 10, "a", 40), (2, 5, 20, "b", 81), (3, 9, 900, "c", 4), (4, 9, 5, "d", 7), (5, 1, 1, "e", None), (6, 5, 10, "A", 12)]
    df = spark.createDataFrame(rows, "id int, signal int, size int, ref string, n int")
    take = lambda **k: [(r.id, r.place, r.tokens) for r in changes.ranked_within_budget(df, "signal", "size", "ref", "n", **k).orderBy("place").collect()]
    assert take() == [(3, 1, 1), (4, 2, 2), (2, 3, 22), (6, 4, 25), (1, 5, 35), (5, 6, 35)]
    assert take(most_bytes=100) == [(4, 1, 1), (2, 2, 21), (6, 3, 24), (1, 4, 34), (5, 5, 34)]
    assert take(most_rows=2) == [(3, 1, 1), (4, 2, 2)] and take(most_tokens=24) == [(3, 1, 1), (4, 2, 2), (2, 3, 22)]


def test_entropy_and_chunks(spark):
    rows = spark.createDataFrame([(1, "aabb"), (2, "aaaa"), (3, ""), (4, None)], "id int, t string")
    got = {r.id: r.entropy for r in texts.shannon_entropy(rows, "id", "t").collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}
    body = spark.createDataFrame([(1, "\n".join(map(str, range(120))))], "id int, t string")
    chunks = texts.code_chunks(body, "id", "t").orderBy("chunk").collect()
    assert [(c.first_line, c.text.split("\n")[0], len(c.text.split("\n"))) for c in chunks] == [(1, "0", 50), (46, "45", 50), (91, "90", 30)]


def test_two_minifications_have_one_hash(spark):
    a = "function add(first, second) { // sum\n  return first + second.len; }\nlet s = 'x';"
    b = 'function q(a,b){return a+b.len;}let z="x";'
    c = 'function q(a,b){return b+a.len;}let z="x";'
    rows = spark.createDataFrame([(1, a), (2, b), (3, c), (4, None), (5, "")], "id int, t string")
    got = {r.id: r.h for r in rows.select("id", canonical_hash(F.col("t")).alias("h")).collect()}
    assert got[1] == got[2] != got[3] and got[4] is None and got[5] is not None


def test_markdown_sections(spark):
    body = "intro\n# A\ntext\n## B\nb1\nb2\n### C\n## D\nd\n# E\n#no heading"
    rows = spark.createDataFrame([(1, body), (2, "plain")], "id int, t string")
    got = [tuple(r) for r in texts.markdown_sections(rows, "id", "t").orderBy("id", "section").collect()]
    assert got == [
        (1, 0, "Intro", "intro", False), (1, 1, "A", "# A\ntext", False), (1, 2, "A > B", "## B\nb1\nb2", False), (1, 3, "A > B > C", "### C", False),
        (1, 4, "A > D", "## D\nd", False), (1, 5, "E", "# E\n#no heading", False), (2, 0, "Intro", "plain", False),
    ]
    more = [(3, "\n \n# A\n\n##### five\n```x\ny```\n\n"), (4, "#  \nrest"), (5, " \n\t"), (6, None), (7, "#### d\n# a\n### c"), (8, "``` open")]
    got = [tuple(r) for r in texts.markdown_sections(spark.createDataFrame(more, "id int, t string"), "id", "t").orderBy("id", "section").collect()]
    assert got == [
        (3, 0, "A", "# A\n\n##### five\n```x\ny```", True), (4, 0, "Intro", "#  \nrest", False), (7, 0, "d", "#### d", False), (7, 1, "a", "# a", False), (7, 2, "a > c", "### c", False), (8, 0, "Intro", "``` open", False),
    ]


def test_levels_with_a_cycle(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("z", "x")], "src string, dst string")
    got = {r.node: r.level for r in graph.leaf_first_levels(edges).collect()}
    assert got == {"c": 0, "b": 1, "a": 2, "x": None, "y": None, "z": None}


def test_jsonl(spark, tmp_path):
    df = spark.createDataFrame([(2, 1, "c"), (1, 2, "b")], "k int, version int, v string")
    export_jsonl(df, str(tmp_path / "out"), ["k"])
    assert values(import_jsonl(spark, str(tmp_path / "out"), "k int, version int, v string")) == values(df)


def test_file_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_bytes(b"hello")
    (tmp_path / "d" / "b.txt").write_bytes(b"hello")
    (tmp_path / "d" / "c.zip").write_bytes(b"PK\x03\x04rest")
    (tmp_path / "d" / "e.bin").write_bytes(b"\x01\x00\x02")
    found = files.directory(spark, str(tmp_path / "d"))
    assert {r.path[-5:]: r.type for r in found.collect()} == {"a.txt": "text", "b.txt": "text", "c.zip": "zip", "e.bin": "binary"}
    blobs, refs = files.content_addressed(found)
    assert blobs.count() == 3 and refs.count() == 4
    (tmp_path / "u.jsonl").write_text('{"ts": "2024-01-01T00:00:00", "event_type": "a"}\nnot json\n')
    assert [r.event_type for r in files.usage_events(spark, str(tmp_path / "u.jsonl")).collect()] == ["a"]
    (tmp_path / "s.json").write_text(json.dumps({"session": "s1", "events": [{"seq": 1, "type": "dom", "data": "{}"}, {"seq": 2, "type": "net"}]}))
    assert [(r.session, r.seq) for r in files.capture_sessions(spark, str(tmp_path / "s.json")).collect()] == [("s1", 1), ("s1", 2)]


def test_storage_events(spark, tmp_path):
    paths = {
        "/r/Local Storage/x": "localstorage", "/r/Local Storage/leveldb/1.ldb": "localstorage", "/r/leveldb/2.log": "leveldb", "/r/a.ldb": None, "/r/a.log": None, "/r/Cookies": "cookies",
        "/r/Cookies-journal": "cookies", "/r/Secure Preferences": "preferences", "/r/x.sqlite": "sqlite", "/r/x.db": "sqlite", "/r/leveldb": None, "/r/x.txt": None, "Cookies": "cookies", "/q/Cookies": "cookies",
    }
    rows = [(p, op, 7) for p in paths for op in ("create", "modify", "delete", "rename")]
    df = spark.createDataFrame(rows, "path string, op string, size long")
    want = [(p.removeprefix("/r/"), op, c, "storage.delete" if op == "delete" else "storage.write", 0 if op == "delete" else 7) for p, c in paths.items() if c for op in ("create", "modify", "delete")]
    got = [(r.path, r.op, r.category, r.type, r.size_delta) for r in events.storage_events(df, "path", "op", "size", "/r").collect()]
    assert sorted(got) == sorted(want)
    df.write.parquet(str(tmp_path / "in"))
    stream = events.storage_events(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "path", "op", "size", "/r")
    query = stream.writeStream.format("memory").queryName("stored").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "point")).start()
    query.awaitTermination(120)
    assert spark.table("stored").count() == len(want)
