"""Rules, merges and graphs on small tables, with nulls and the cases that the driver's tables don't have."""

import json
import random

import pytest
from pyspark.sql import functions as F
from stratalog.functions import score as S
from stratalog.functions import shapes as P
from stratalog.functions import times as T
from stratalog.operators import changes, events, graph, json_docs, keys, matching, regressions, search, texts
from stratalog.operators.registries import Registry, first_label
from stratalog.sources import files
from stratalog.sources.kvlog import key_value_log


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_levels_of_a_long_chain(spark):
    """As many levels as there are, in few enough rounds to wait for."""
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 13)] + [(5, 1), (12, 3)], "src long, dst long")
    got = {r.node: r.level for r in graph.leaf_first_levels(edges).collect()}
    assert got == {i: i for i in range(13)}


def test_cycles_become_one_unit(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("f", "f"), ("z", "a")], "src string, dst string")
    got = {r.node: (r.component, r.level) for r in graph.collapsed_levels(edges).collect()}
    assert got == {"a": ("a", 1), "b": ("a", 1), "c": ("c", 0), "d": ("c", 0), "e": ("c", 0), "f": ("f", 0), "z": ("z", 2)}


def test_alias_chains_are_refused(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("x",)], "id string")
    aliases = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "alias string, whole string")
    got = {r.id: r.canonical for r in graph.resolve_aliases(ids, aliases, "id", "alias", "whole").collect()}
    assert got == {"a": "a", "b": "c", "c": "c", "x": "y"}


def test_upserts_keep_rows_with_nulls(spark):
    old = spark.createDataFrame([(1, None, "a"), (2, "manual", "b"), (3, "scan", "c")], "k int, owner string, v string")
    new = spark.createDataFrame([(2, "scan", "B"), (3, "scan", "C"), (4, None, "D")], "k int, owner string, v string")
    assert rows(keys.upsert_protected(old, new, ["k"], "owner", "manual")) == [(1, None, "a"), (2, "manual", "b"), (3, "scan", "C"), (4, None, "D")]
    a = spark.createDataFrame([(None, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(None, ""), (1, "Y"), (2, None)], "k int, v string")
    assert rows(keys.upsert_keep_known(a, b, ["k"])) == [(1, "Y"), (2, None), (None, "x")]


@pytest.mark.parametrize("known", [[(1,), (2,)], [(1,), (None,)], []])
def test_not_in_is_that_of_sql(spark, known):
    left = spark.createDataFrame([(1, "a"), (3, "b"), (None, "c")], "k int, v string")
    right = spark.createDataFrame(known, "j int")
    want = spark.sql("SELECT * FROM {l} WHERE k NOT IN (SELECT j FROM {r})", l=left, r=right)
    assert rows(keys.not_in(left, right, "k", "j")) == rows(want)


def test_merges_and_numbers(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    more = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    assert rows(keys.merge_preferring(base, more, ["k"])) == [("a", 1), ("b", 2), ("c", 3)]
    content = spark.createDataFrame([(1, None), (2, ""), (3, "h"), (4, "h")], "id int, sha string")
    assert [r[0] for r in rows(keys.once_per_content(content, "sha", "id"))] == [1, 2, 3]
    with pytest.raises(ValueError):
        keys.count_by_allowed(base, "v", ("k",))


def test_budget_as_a_running_sum(spark):
    data = [(g, c, i) for i, (g, c) in enumerate([("a", 5), ("a", 0), ("a", 7), ("a", 100), ("a", 6), ("b", 50), (None, 3), (None, 4)])]
    df = spark.createDataFrame(data, "g string, c int, i int")
    want, total = [], {}
    for g, c, i in sorted(data, key=lambda r: (str(r[0]), r[1], r[2])):
        total[g] = total.get(g, 0) + c
        if total[g] <= 18:
            want.append((g, c, i, total[g]))
    assert rows(changes.running_budget(df, "g", ["c", "i"], "c", 18)) == sorted(want, key=str)


def test_consecutive_diffs(spark):
    facts = spark.createDataFrame([("k", 1, "x", "1"), ("k", 1, "y", None), ("k", 2, "x", "2"), ("k", 2, "z", None), ("k", 4, "x", "2"), ("m", 1, "x", "1")], "kb string, epoch int, key string, v string")
    got = rows(changes.consecutive_diff(facts, "kb", "epoch", ["key"], "v"))
    assert got == sorted([("k", 2, "x", "1", "2", "modified"), ("k", 2, "y", None, None, "removed"), ("k", 2, "z", None, None, "added"),
                          ("k", 3, "x", "2", None, "removed"), ("k", 3, "z", None, None, "removed"), ("k", 4, "x", None, "2", "added")], key=str)


def test_changes_of_some_epochs_in_one_shuffle(spark):
    """As consecutive_diff of all epochs, from the one asked for on; facts are shuffled once."""
    rng = random.Random(3)
    given = [(g, e, k, rng.choice(["1", "2", None])) for g in "abc" for e in range(1, 7) for k in ("x", "y", None) if rng.random() < 0.6 and (g, e) != ("b", 4)]
    facts = spark.createDataFrame(given, "kb string, epoch int, key string, v string")
    span = spark.createDataFrame([("a", 1, 6), ("b", 3, 7), ("c", 5, 6)], "kb string, first int, last int")
    every = rows(changes.consecutive_diff(facts, "kb", "epoch", ["key"], "v", last=span.select("kb", F.col("last").alias("last_epoch"))))
    asked = facts.join(span.hint("broadcast"), "kb").where("epoch >= first - 1")
    got = changes.epoch_changes(asked, "kb", "epoch", ["key"], "v", "first", "last")
    first = {"a": 1, "b": 3, "c": 5}
    assert rows(got) == [r for r in every if r[1] >= first[r[0]]] and len(rows(got)) > 10
    assert got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_guard_needs_three_failures_within_the_span(spark):
    times = ["00:00:00", "00:00:05", "00:00:10", "00:00:14.9", "00:01:00"]
    df = spark.createDataFrame([("u", f"2024-01-01 {t}", 1) for t in times], "u string, t string, code int").withColumn("t", F.col("t").cast("timestamp"))
    got = events.failure_guard(df, "u", "t", F.col("code") != 0, 10).collect()
    assert [(str(r.t)[14:], r.failures) for r in got] == [("00:14.900000", 3)]  # 0 s and 10 s are ten seconds apart, which is out


def test_missing_metrics_weigh_nothing(spark):
    score = lambda v: one(spark, S.cvss3_base_score(F.lit(v)))
    assert score("CVSS:3.1/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H") == 5.9  # no reach: only the impact counts
    assert score("CVSS:3.1/AV:X/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H") == 5.9
    assert score("nothing") == 0.0 and one(spark, S.cvss3_base_score(F.lit(None).cast("string"))) is None
    assert [one(spark, S.cvss_level(F.lit(v))) for v in (0.0, 0.1, 4.0, 7.0, 9.0)] == ["none", "low", "medium", "high", "critical"]
    assert one(spark, S.capped(F.lit(9), 5, 30)) == 30


def test_triage_topics_and_vendored_names(spark):
    cls = lambda body, name=None: one(spark, texts.triage(F.lit(body), None if name is None else F.lit(name)))
    assert cls("x" * 255) == "SKIP" and cls("x" * 256) == "ENRICH" and cls("é" * 128) == "ENRICH"
    assert cls("x" * 300, "react-dom-4f2") == "SKIP" and cls("x" * 300, "reactor") == "ENRICH"
    assert cls("import {a} from '@scope/pkg';" + "y" * 300) == "SKIP"
    assert cls("a.licensed = 1; // Licensed under" + "y" * 300) == "ENRICH"
    topic = lambda role, tags, summary: one(spark, texts.topic(F.lit(role), F.lit(tags), F.lit(summary)))
    assert topic("send", "zzz", "") == "messaging" and topic(" Pair ", "", "") == "auth"
    assert topic("src8", "zzz", "") == "other" and topic("util", "", "") == "other"
    assert topic("send", "", "uses a cipher") == "crypto" and topic(None, None, None) == "other"


def test_names_symbols_and_entropy(spark):
    assert one(spark, P.promoted_name(F.lit('x("src/app/Main.view.tsx")'))) == "Main.view"
    assert one(spark, P.promoted_name(F.lit("nothing"))) is None and one(spark, P.synthetic_name(F.lit(""))) is None
    P.register_language("tiny", {"functions": (r"def (\w+)",)})
    assert one(spark, P.symbols(F.lit("def a() def b() def a()"), "tiny", "functions")) == ["a", "b"]
    assert one(spark, P.symbols(F.lit("def a()"), "tiny", "classes")) == []
    assert one(spark, P.entropy(F.lit("aabb"))) == 1.0 and one(spark, P.entropy(F.lit(None).cast("string"))) == 0.0
    assert one(spark, P.without_overlap(F.lit("a\nb\n c "), F.lit("b\nc\nd"))) == "d"
    assert one(spark, P.without_overlap(F.lit("a\n"), F.lit("\nd"))) == "\nd"
    assert [one(spark, P.by_extension(F.lit(n), P.PLATFORMS, "other")) for n in ("a.EXE", "a.b/c", "")] == ["windows-pe", "other", "other"]


def test_json_that_is_none(spark):
    docs = spark.createDataFrame([(1, "not json"), (2, None), (3, "[]"), (4, '{"dependencies":{"a":1},"urls":["",7,"https://h/p","plain"],"framework":7}')], "id int, doc string")
    assert rows(json_docs.extract_facts(docs, "id", "doc")) == [(4, "url", "h", "https://h/p"), (4, "url", "plain", "plain")]
    nested = spark.createDataFrame([(1, json.dumps({"a": {"b": {"c": [1, {"d": 2}]}, "e": {}}, "f": None}))], "id int, doc string")
    assert rows(json_docs.pieces(nested, "id", "doc")) == [(1, "a > b > c", '[1,{"d":2}]'), (1, "a > e", "{}"), (1, "f", "null")]
    assert one(spark, json_docs.same_json(F.lit('{"a":1, "b":[1]}'), F.lit('{"b":[1],"a":1}'))) is True
    assert one(spark, json_docs.same_json(F.lit("x"), F.lit("x"))) is False
    assert one(spark, F.to_json(F.to_variant_object(json_docs.objects_of(F.parse_json(F.lit('["a",{"b":1},3]')))))) == '[{"b":1}]'


def test_rules_of_users_and_registries(spark):
    merged = regressions.merge_rules([regressions.Rule("a", "low"), regressions.Rule("b", "low")], [regressions.Rule("b", "high", source="user"), regressions.Rule("c", "low")])
    assert [(r.id, r.severity) for r in merged] == [("a", "low"), ("b", "high"), ("c", "low")]
    labels = Registry()
    labels.register("never", lambda: F.lit(None).cast("string"))
    assert one(spark, first_label(labels)) == "unknown"
    labels.register("never", lambda: F.lit("now"))
    assert one(spark, first_label(labels)) == "now" and len(labels) == 1
    with pytest.raises(KeyError):
        labels["missing"]


def test_optional_filters_and_tags(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, None), (3, [])], "id int, tags array<string>")
    assert [r.id for r in df.where(search.overlaps(F.col("tags"), ["b", "c"])).collect()] == [1]
    assert df.where(search.overlaps(F.col("tags"), None) & search.optional(F.col("id"), None)).count() == 3


def test_sources_by_alias(spark):
    spine = spark.createDataFrame([("V1", ["C1", ""]), ("V2", None)], "id string, aliases array<string>")
    nvd = spark.createDataFrame([("C1", "x"), ("V2", "y"), ("C9", "z")], "alias string, value string")
    local = spark.createDataFrame([("C1",), ("L7",)], "alias string")
    assert rows(matching.merge_sources(spine, {"nvd": nvd}, "local", local)) == [("L7", ["local"], []), ("V1", ["local", "nvd", "spine"], ["x"]), ("V2", ["nvd", "spine"], ["y"])]


def test_times(spark):
    assert one(spark, T.from_chromium(F.lit(0).cast("long"))) is None
    assert str(one(spark, T.from_chromium(F.lit(13_350_000_000_000_000)))).startswith("2024-01-17")
    day = F.lit("2024-01-01 00:00:01.5").cast("timestamp")
    assert one(spark, T.to_millis(day)) == 1_704_067_201_500 and one(spark, T.iso(day)) == "2024-01-01T00:00:01+00"


def test_readers_of_archives_lists_and_trees(spark, tmp_path):
    (tmp_path / "a.har").write_text(json.dumps({"log": {"entries": [{"request": {"method": "GET", "url": "u"}, "response": {"status": 200}}]}}))
    assert rows(files.har_entries(spark, str(tmp_path / "a.har"))) == [("GET", "u", 200)]
    (tmp_path / "l.csv").write_text("id,name\n1,x\n2,y\n")
    assert rows(files.csv_list(spark, str(tmp_path / "l.csv"), "id int, name string")) == [(1, "x"), (2, "y")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.json").write_text('{"k": 1}')
    (tmp_path / "t" / "b.json").write_text("{broken")
    got = {r.path[-6:]: r.t for r in files.json_trees(spark, str(tmp_path / "t")).select("path", F.to_json("tree").alias("t")).collect()}
    assert got == {"a.json": '{"k":1}', "b.json": None}
    (tmp_path / "kv").mkdir()
    (tmp_path / "kv" / "one.log").write_text('{"key": "a", "value": "1", "sequence": 1, "type": "put"}\n{broken\n{"key": "a", "sequence": 2, "type": "delete"}\n{"key": "b"}\n')
    assert rows(key_value_log(spark, str(tmp_path / "kv"))) == [("one.log", "a", "1", 1, "put"), ("one.log", "a", None, 2, "delete")]
