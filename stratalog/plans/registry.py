"""All named queries and SQL twins of the catalogue part."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalog.plans import (
    bundle_queries,
    catalog_queries,
    event_queries,
    extension_queries,
    finding_queries,
    index_queries,
    ingest_queries,
    job_queries,
    json_queries,
    match_queries,
    risk_queries,
    search_queries,
    shape_queries,
    snapshot_queries,
    text_queries,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for _module in (
    catalog_queries, event_queries, text_queries, json_queries, search_queries, shape_queries, ingest_queries, extension_queries, index_queries, finding_queries, bundle_queries, match_queries, job_queries, snapshot_queries, risk_queries,
):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
