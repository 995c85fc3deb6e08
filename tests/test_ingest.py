"""Ingestion as one unit: known contents, dead runs, repeated batches and streams."""

import pytest
from pyspark.sql import functions as F
from stratalog.operators import ingest
from stratalog.plans import snapshot_queries


def snapshot(kb, sha, at, modules=(), facts=(), name="App", doc="{}"):
    rows = [(kb, sha, at, "snapshot", None, name, doc)]
    rows += [(kb, sha, at, "module", None, n, b) for n, b in modules]
    return rows + [(kb, sha, at, "fact", c, k, v) for c, k, v in facts]


FIRST = snapshot("a", "s1", 10, [("m1", "one"), ("m2", "two"), ("m3", "one")], [("dep", "x", "1"), ("url", "u", None), ("odd", "o", "1")], "Alpha", '{"security":{"risk_score":55}}')
FIRST += snapshot("b", "t1", 11, [("m1", "one")], [("dep", "x", "1")]) + snapshot(None, "n", 1) + snapshot("a", "s1", 12, [("m9", "nine")])
SECOND = snapshot("a", "s1", 20, [("m4", "four")]) + snapshot("a", "s2", 21, [("m1", "one"), ("m5", "five")], [("dep", "x", "2"), ("dep", "y", "1")], "Renamed") + snapshot("a", "s3", 22) + snapshot("c", "c1", 5)


@pytest.fixture
def catalogue(spark, tmp_path):
    return ingest.Catalogue(spark, f"file://{tmp_path}/kb")


def give(catalogue, rows, batch):
    return ingest.ingest(catalogue, catalogue.spark.createDataFrame(rows, ingest.BATCH), batch)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)


def state(c):
    tables = {n: rows(c.rows(n).drop("batch")) for n in ("knowledge_sources", "module_bodies", "module_app_refs", "app_facts", "kb_diffs")}
    return tables | {"apps": rows(c.apps()), "modules": rows(c.modules()), "facts": rows(c.facts())}


def test_two_batches(catalogue):
    assert give(catalogue, FIRST, 0) and give(catalogue, SECOND, 1)
    sources = rows(catalogue.rows("knowledge_sources"), "kb_id", "binary_sha256", "epoch", "risk_score", "risk_level", "depth_score", "modules_indexed", "bodies_indexed")
    assert sources == [("a", "s1", 1, 55, "high", 29, 4, 3), ("a", "s2", 2, None, "unknown", 14, 2, 2), ("a", "s3", 3, None, "unknown", 0, 0, 0), ("b", "t1", 1, None, "unknown", 14, 1, 1), ("c", "c1", 1, None, "unknown", 0, 0, 0)]
    assert rows(catalogue.rows("module_bodies"), "body", "body_size") == [("five", 4), ("nine", 4), ("one", 3), ("two", 3)]
    assert rows(catalogue.apps()) == [("a", "Alpha", 10, 22), ("b", "App", 11, 11), ("c", "App", 5, 5)]
    assert rows(catalogue.modules(), "kb_id", "name", "last_seen_at") == [("a", "m1", 21), ("a", "m2", 10), ("a", "m5", 21), ("a", "m9", 10), ("b", "m1", 11)]
    assert rows(catalogue.rows("kb_diffs").drop("batch")) == [
        ("a", 2, "dep", "x", "1", "2", "modified"), ("a", 2, "dep", "y", None, "1", "added"), ("a", 2, "odd", "o", "1", None, "removed"), ("a", 2, "url", "u", None, None, "removed"),
        ("a", 3, "dep", "x", "2", None, "removed"), ("a", 3, "dep", "y", "1", None, "removed"),
    ]
    assert rows(catalogue.facts()) == [("b", 1, "dep", "x", "1")]  # the newest epoch of a has none


def test_a_batch_again_is_nothing(catalogue):
    assert give(catalogue, FIRST, 0) and give(catalogue, SECOND, 1)
    before = state(catalogue)
    assert not give(catalogue, FIRST, 0) and not give(catalogue, SECOND, 1) and state(catalogue) == before
    assert give(catalogue, SECOND, 2)
    after = state(catalogue)
    assert {k: v for k, v in after.items()} == before and catalogue.batches() == [0, 1, 2]


def test_a_dead_run_is_not_seen(catalogue, monkeypatch):
    assert give(catalogue, FIRST, 0)
    before = state(catalogue)
    write = ingest.Catalogue.write

    def dies(self, table, batch, df):
        if table == "kb_diffs":
            raise OSError("lost")
        return write(self, table, batch, df)

    monkeypatch.setattr(ingest.Catalogue, "write", dies)
    with pytest.raises(OSError, match="lost"):
        give(catalogue, SECOND, 1)
    assert state(catalogue) == before and catalogue.batches() == [0]
    monkeypatch.setattr(ingest.Catalogue, "write", write)
    assert give(catalogue, SECOND, 1)
    assert rows(catalogue.rows("knowledge_sources"), "kb_id", "epoch") == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 1)]


def test_of_two_writers_one_wins(catalogue):
    assert give(catalogue, FIRST, 0)
    with pytest.raises(Exception, match="exist"):
        catalogue.mark(0)


def test_stream(spark, catalogue, tmp_path):
    for i, batch in enumerate((FIRST, SECOND)):
        spark.createDataFrame(batch, ingest.BATCH).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    for i in range(2):
        stream = spark.readStream.schema(ingest.BATCH).parquet(f"{tmp_path}/in/{i}")
        query = ingest.ingest_stream(stream, catalogue.path if i == 0 else f"{catalogue.path}-{i}", f"{tmp_path}/point{i}")
        query.awaitTermination(300)
        assert query.exception() is None
    assert rows(catalogue.rows("knowledge_sources"), "kb_id", "epoch") == [("a", 1), ("b", 1)]
    assert catalogue.rows("app_facts").where(F.col("kb_id") == "a").count() == 3


def test_a_batch_is_read_four_times(spark, catalogue):
    """Once for heads, modules and facts each, and once more for contents; for heads alone where all of it is known."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    given = spark.createDataFrame(FIRST, ingest.BATCH).coalesce(1).mapInArrow(counted, ingest.BATCH)
    assert ingest.ingest(catalogue, given, 0) and read.value <= 4 * len(FIRST)
    before, read.value = state(catalogue), 0
    assert ingest.ingest(catalogue, given, 1) and read.value <= len(FIRST)
    assert state(catalogue) == before


def test_names_and_contents_that_are_null(catalogue):
    first = snapshot("a|b", "c", 1, [("m1", None), (None, "one"), ("m2", "one"), ("m2", "one")], [(None, "k", "1"), ("dep", None, None)])
    first += snapshot("a", "b|c", 1, [("m3", "two")], [("dep", "k", "9")])  # its source_id is the other one's
    assert give(catalogue, first, 0)
    assert rows(catalogue.rows("module_bodies"), "body", "body_size") == [("one", 3), ("two", 3), (None, None)]
    assert rows(catalogue.modules(), "kb_id", "name") == [("a", "m3"), ("a|b", "m1"), ("a|b", None)]
    assert rows(catalogue.facts(), "kb_id", "category", "key", "value") == [("a", "dep", "k", "9"), ("a|b", "dep", None, None), ("a|b", None, "k", "1")]


def test_rows_are_counted_by_bytes_of_digests(spark):
    refs = spark.createDataFrame([("00ff", "ab"), ("00ff", "ab"), ("00ff", "ac"), ("01ff", "ab")], "source_id string, body_sha256 string")
    got = snapshot_queries._counted("refs", refs)
    assert [tuple(r) for r in got.collect()] == [("refs", 4, 3)]
    assert "unhex(source_id" in got._jdf.queryExecution().optimizedPlan().toString()
    same = spark.createDataFrame([("a", "ab", "m", 1), ("a", "ab", "m", 2)], "kb_id string, body_sha256 string, name string, last_seen_at long")
    assert [tuple(r) for r in snapshot_queries._counted("modules", same).collect()] == [("modules", 2, 2)]
