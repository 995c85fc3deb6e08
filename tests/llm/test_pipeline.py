import random
from collections import Counter

import corpus_pipeline
import __spark_entry__ as entry

from tests.llm.fixtures import frame, words
from tests.llm.test_near_dup import brute_components


def write_tables(spark, folder, rows, labels):
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def corpus():
    rng = random.Random(3)
    good = [(i, words(rng, rng.randint(40, 120)), "en", f"s{i % 3}", 0) for i in range(120)]
    bad = [(500 + i, " ".join(w + "$$$" for w in words(rng, 60).split()), "en", "s0", 0) for i in range(40)]
    base = words(rng, 100).split()
    near = [(700 + k, " ".join([*base[:-1], f"e{k}"]), "en", "s1", 0) for k in range(6)]
    passage = words(rng, 70)
    shared = [(800 + k, f"{words(rng, 60)} {passage} {words(rng, 60)}", "en", "s2", 0) for k in range(4)]
    rows = [(i, t, lang, s, len(t)) for i, t, lang, s, _ in good + bad + near + shared] + [(None, None, None, None, None)]
    return rows, [(r[0], int(not 500 <= r[0] < 600), 0) for r in rows if r[0] is not None and r[0] % 2 == 0]


def test_stages_take_effect_one_after_the_other(spark, tmp_path):
    rows, labels = corpus()
    sf_dir = write_tables(spark, tmp_path / "in", rows, labels)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        assert name == "packing" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out[name] = docs.collect()
    ids = {k: {r.doc_id for r in v} for k, v in out.items()}
    assert ids["quality"] >= {r[0] for r in rows if r[0] is not None and not 500 <= r[0] < 600}
    assert not any(i is not None and 500 <= i < 600 for i in ids["quality"])
    want = brute_components([(r.doc_id, r.text) for r in out["quality"]], 5)
    assert ids["near_dedup"] == {i for i, (_, c) in want.items() if i == c} and len(out["near_dedup"]) == len(ids["near_dedup"])
    cut = {r.doc_id: r for r in out["substring_dedup"]}
    assert all(r.n_chars == len(r.text) for r in cut.values() if r.text is not None)
    assert sum(len(cut[800 + k].text.split()) < 160 for k in range(4)) == 3
    assert all(n <= 2 for i, n in Counter(r.doc_id for r in out["mixing"]).items())
    assert ids["packing"] == ids["mixing"]
    run = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(map(tuple, run)) == Counter(map(tuple, out["packing"]))


def test_stages_take_empty_tables(spark, tmp_path):
    sf_dir = write_tables(spark, tmp_path / "in", [], [])
    assert corpus_pipeline.run(spark, sf_dir).collect() == []


def test_every_query_is_registered_once():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stages_keep_clashing_columns(spark, tmp_path):
    """Columns named like those that operators add or use come through with their own values; long and repeated rows too."""
    rows, labels = corpus()
    rng = random.Random(8)
    rows += [(900, words(rng, 20_000), "en", "s1", 1), (901, "", "en", None, 0), rows[0]]
    sf_dir = write_tables(spark, tmp_path / "in", rows, labels)
    names = ("and no more", "score", "predicted", "removed_words", "spans", "copies", "size", "kept_id", "class", "id", "row", "text_hash", "rank")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", *[f"'own {n}' AS `{n}`" for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = docs.select(*[f"`{n}`" for n in names]).distinct().collect()
        assert [tuple(r) for r in got] == [tuple(f"own {n}" for n in names)]
    assert 900 in {r.doc_id for r in docs.collect()}
