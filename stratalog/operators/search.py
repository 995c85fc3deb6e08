"""Catalogue search: ranked by trigram similarity, paged by key, with a fallback to bodies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions import text as X
from stratalog.operators import trigram_index

LARGEST_PAGE = 500


def clamp_limit(limit: int, most: int = LARGEST_PAGE) -> int:
    return most if limit <= 0 or limit > most else limit


def relevance(query: str, name: Column, summary: Column, everything: Column) -> Column:
    """Weighted similarity of a query to name (2), summary (1.5) and all searchable text (1)."""
    q = F.lit(query)
    similar = lambda c: X.trigram_similarity(F.coalesce(c, F.lit("")), q)
    return 2.0 * similar(name) + 1.5 * similar(summary) + similar(everything)


def search(rows: DataFrame, query: str, id_col: str, name: str, summary: str, fields: Sequence[str], limit: int = 50) -> DataFrame:
    """Rows whose searchable text contains the query, most relevant first, ties by id.

    The literal filter runs before any similarity is computed.
    """
    found = rows.withColumn("search_text", X.search_text(*fields)).where(X.contains_ci(F.col("search_text"), query))
    ranked = found.withColumn("relevance", relevance(query, F.col(name), F.col(summary), F.col("search_text")))
    return ranked.orderBy(F.desc("relevance"), id_col).limit(clamp_limit(limit))


def optional(column: Column, value) -> Column:
    """``column = value``, or no condition where no value is given."""
    return F.lit(True) if value is None else column == F.lit(value)


def overlaps(tags: Column, wanted: Sequence[str] | None) -> Column:
    """Whether an array shares an element with ``wanted``; no condition where none is given. Null arrays share nothing."""
    if wanted is None:
        return F.lit(True)
    return F.coalesce(F.arrays_overlap(tags, F.array(*[F.lit(t) for t in wanted])), F.lit(False))


def ranked_search(
    modules: DataFrame,
    refs: DataFrame,
    sources: DataFrame,
    apps: DataFrame,
    components: DataFrame,
    enrichment: DataFrame,
    query: str,
    app: str | int | None = None,
    component: str | None = None,
    since=None,
    after: tuple | None = None,
    limit: int = 50,
    least: float = 0.3,
    index: trigram_index.TrigramIndex | None = None,
) -> DataFrame:
    """Modules that contain the query or are similar to it, with every snapshot and application that refers to them.

    Tables: modules (module_id, name, search_text, body), refs (body, source_id), sources (source_id, kb_id, captured_at),
    apps (kb_id, display_name), components (module_id, component), enrichment (module_id, role). The text filter runs
    before any join. Order: similarity, then newest snapshot, then id; ``after`` is the last row of the page before.

    With an ``index`` of ``search_text`` by module_id, similarity is computed for the rows that its posting lists name, no
    others; the result is the same.
    """
    modules = _narrowed(modules, "module_id", index, query, least)
    similar = X.trigram_similarity(F.col("search_text"), F.lit(query))
    hits = modules.withColumn("sim", similar).where((F.col("sim") >= least) | X.contains_ci(F.col("search_text"), query))
    found = hits.join(refs, "body").join(sources, "source_id").join(apps, "kb_id")
    found = found.join(components, "module_id", "left").join(enrichment, "module_id", "left")
    found = found.where(optional(F.col("kb_id"), app) & optional(F.col("component"), component))
    if since is not None:
        found = found.where(F.col("captured_at") >= F.lit(since).cast(sources.schema["captured_at"].dataType))
    if after is not None:
        sim, at, last = F.lit(after[0]), F.lit(after[1]).cast(sources.schema["captured_at"].dataType), F.lit(after[2])
        tied = (F.col("sim") == sim) & ((F.col("captured_at") < at) | ((F.col("captured_at") == at) & (F.col("module_id") > last)))
        found = found.where((F.col("sim") < sim) | tied)
    named = found.select(
        "module_id", "name", "sim", "kb_id", "display_name", "captured_at", "source_id",
        F.coalesce("component", F.lit("other")).alias("component"), F.coalesce("role", F.lit("")).alias("role"),
    )
    return named.orderBy(F.desc("sim"), F.desc("captured_at"), "module_id").limit(clamp_limit(limit))


def _narrowed(rows: DataFrame, id_col: str, index: trigram_index.TrigramIndex | None, query: str, least: float) -> DataFrame:
    named = trigram_index.candidates(index, rows.sparkSession, query, least) if index else None
    return rows if named is None else rows.join(named.withColumnRenamed("id", id_col), id_col, "left_semi")


def similar_page(
    rows: DataFrame, query: str, text: str, at: str, id_col: str, limit: int, after: tuple | None = None, least: float = 0.3, index: trigram_index.TrigramIndex | None = None
) -> DataFrame:
    """A page of rows similar to the query, by (similarity desc, at desc, id asc), from behind ``after``.

    With an ``index`` of the text by id only the rows that it names are looked at.
    """
    if index and least > 0:
        named = trigram_index.similar_ids(index, rows.sparkSession, query, least).withColumnRenamed("id", id_col)
        rows = rows.join(named, id_col, "left_semi")
    scored = rows.withColumn("similarity", X.trigram_similarity(F.col(text), F.lit(query))).where(F.col("similarity") >= least)
    if after is not None:
        sim, moment, last = after
        same = F.col("similarity") == sim
        scored = scored.where(
            (F.col("similarity") < sim) | (same & (F.col(at) < moment)) | (same & (F.col(at) == moment) & (F.col(id_col) > last))
        )
    return scored.orderBy(F.desc("similarity"), F.desc(at), id_col).limit(clamp_limit(limit))


def with_fallback(first: DataFrame, fallback: DataFrame, id_col: str, limit: int) -> DataFrame:
    """``first`` unless it is empty, then ``fallback``; decided inside the plan, without an action.

    Both have the same columns; at most ``limit`` rows of each are looked at.
    """
    a = first.limit(limit).withColumn("branch", F.lit(0))
    b = fallback.limit(limit).withColumn("branch", F.lit(1))
    both = a.unionByName(b)
    chosen = both.agg(F.min("branch").alias("chosen"))
    return both.join(F.broadcast(chosen), F.col("branch") == F.col("chosen")).drop("chosen")
