"""Searches by an index of trigrams. Each query builds its index and then looks things up in it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratalog.functions import text as X
from stratalog.operators import search, trigram_index
from stratalog.operators.work import shared_dir
from stratalog.plans import search_queries as S
from stratalog.plans import text_queries as T
from stratalog.plans.tables import table


def _index(rows, id_col, text):
    return trigram_index.build(rows, id_col, text, f"{shared_dir(rows.sparkSession)}/trigrams-{uuid.uuid4().hex}")


def search_indexed_joined(spark, sf_dir):
    """``search_ranked_joined`` by an index of the searchable texts."""
    catalogue = S._catalogue(spark, sf_dir)
    index = _index(catalogue[0], "module_id", "search_text")
    found = search.ranked_search(*catalogue, "red ring", since=S.SINCE, limit=100, least=0.35, index=index)
    return found.select("module_id", F.round("sim", 9).alias("sim"), "kb_id", "display_name", "captured_at", "source_id", "component", "role")


def search_indexed_page(spark, sf_dir):
    """``search_trigram_page`` by an index of the names."""
    rows = T._parts(spark, sf_dir)
    index = _index(rows, "p_partkey", "p_name")
    page = search.similar_page(rows, "red ring", "p_name", "p_size", "p_partkey", 15, after=T._FIRST, least=0.2, index=index)
    return page.select("p_partkey", "p_size", F.round("similarity", 9).alias("similarity"))


#: Needles of which texts hold none, few or many; one is cut within words, one has signs and capitals.
NEEDLES = ("licensed under", "ensed und", "Apache License, Version 2.0", "zqx jvq", "ration", "token = \"")


def search_indexed_bodies(spark, sf_dir):
    """Documents whose whole text contains a needle, by an index of all texts, and how many needles each contains."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = _index(docs, "doc_id", "text")
    hits = None
    for needle in NEEDLES:
        named = trigram_index.containing_ids(index, spark, needle).withColumnRenamed("id", "doc_id")
        found = docs.join(named, "doc_id", "left_semi").where(X.contains_ci(F.col("text"), needle)).select("doc_id", F.lit(needle).alias("needle"))
        hits = found if hits is None else hits.unionByName(found)
    return hits.groupBy("doc_id").agg(F.count("*").alias("needles"), F.min("needle").alias("least"))


QUERIES = {f.__name__: f for f in (search_indexed_joined, search_indexed_page, search_indexed_bodies)}

ORACLE_SQL = {
    "search_indexed_joined": S.ORACLE_SQL["search_ranked_joined"],
    "search_indexed_page": T.ORACLE_SQL["search_trigram_page"],
    "search_indexed_bodies": "SELECT doc_id, count(*) AS needles, min(needle) AS least FROM documents JOIN (VALUES {}) t(needle) ON contains(lower(text), lower(needle)) GROUP BY doc_id".format(
        ", ".join(f"('{n}')" for n in NEEDLES)
    ),
}
