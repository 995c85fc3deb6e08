"""The trigram index names every row that a scan finds, and reads a few posting lists for it."""

import random
import re

import pytest
from pyspark.sql import functions as F
from stratalog.functions import text as X
from stratalog.operators import search, trigram_index
from stratalog.plans import search_queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    words = ["red", "ring", "ringlet", "blue", "a", "ab", "under", "understand", "License", "2.0", "x-y", "e9f", "naïve", "ÉTÉ"]
    texts = [rng.choice([" ", "-", ", ", "_", "."]).join(rng.choice(words) for _ in range(rng.randint(1, 7))) for _ in range(300)]
    texts += [None, "", "   ", "!!!", "red ring", "RED RING", "the red-ring of it", "hundred rings", "red  ring"]
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    return trigram_index.build(rows, "id", "text", f"file://{tmp_path_factory.mktemp('index')}/i", folders=5)


@pytest.mark.parametrize("query", ["red ring", "ring", "understand", "License, 2.0", "blue a", "qqq", "naïve", "x"])
@pytest.mark.parametrize("least", [0.1, 0.3, 0.7, 1.0])
def test_similar_rows_are_all_named(spark, rows, index, query, least):
    want = {r.id for r in rows.where(X.trigram_similarity(F.col("text"), F.lit(query)) >= least).collect()}
    got = {r.id for r in trigram_index.similar_ids(index, spark, query, least).collect()}
    assert want <= got
    if least == 1.0:
        assert len(got) <= len(want) + 60


@pytest.mark.parametrize("needle", ["red ring", "ed rin", "RING", "ring", "der", "License, 2.0", "_a", "zzz", "stand", "d-r", "d r", "é"])
def test_containing_rows_are_all_named(spark, rows, index, needle):
    want = {r.id for r in rows.where(X.contains_ci(F.col("text"), needle)).collect()}
    named = trigram_index.containing_ids(index, spark, needle)
    if named is None:
        assert not any(len(w) > 2 for w in re.findall("[a-z0-9]+", needle.lower()))
    else:
        assert want <= {r.id for r in named.collect()}


def test_plan_prunes_by_trigram(spark, index):
    """The lookup lists the folders of its trigrams alone, and trigrams reach the scan as literals."""
    plan = index.postings(spark, ["red", " ri"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*folder#\d+ (IN|=|INSET)", plan) and re.search(r"PushedFilters: \[.*(In\(gram|EqualTo\(gram)", plan)


def test_fewer_lists_than_trigrams(spark, index):
    """The prefix of the rarest trigrams is shorter than the query."""
    grams = trigram_index.query_grams(spark, "understand ringlet")
    plan = trigram_index.similar_ids(index, spark, "understand ringlet", 0.7)._jdf.queryExecution().optimizedPlan().toString()
    read = re.search(r"gram#\d+ IN \(([^)]*)\)", plan)
    assert read is None or len(read[1].split(",")) <= len(grams) - 9


@pytest.mark.parametrize("query", ["red ring", "ring", "steel", "#13", "a"])
def test_ranked_search_is_the_same(spark, tmp_path, query):
    catalogue = search_queries._catalogue(spark, SF_DIR)
    index = trigram_index.build(catalogue[0], "module_id", "search_text", f"file://{tmp_path}/i")
    for least in (0.05, 0.35):
        found = search.ranked_search(*catalogue, query, limit=200, least=least, index=index)
        if "ring" in query:  # else nothing is named, and the plan is empty, or everything is
            plan = found._jdf.queryExecution().optimizedPlan().toString()
            assert "LeftSemi" in plan and re.search(r"gram#\d+ IN|gram#\d+ =", plan)
        with_index = found.collect()
        assert with_index == search.ranked_search(*catalogue, query, limit=200, least=least).collect()


def test_page_is_the_same(spark, rows, tmp_path):
    index = trigram_index.build(rows, "id", "text", f"file://{tmp_path}/i")
    dated = rows.withColumn("at", F.col("id") % 7)
    for after in (None, (0.5, 3, 10)):
        page = lambda **k: search.similar_page(dated, "red ring", "text", "at", "id", 20, after=after, **k)  # noqa: B023, E731
        with_index = page(index=index)
        assert "LeftSemi" in with_index._jdf.queryExecution().optimizedPlan().toString() and with_index.collect() == page().collect()
