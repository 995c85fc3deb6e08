"""Ingestion of snapshots in two batches, each given twice. A customer is an application, a priority of its orders a content."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators import ingest
from stratalog.operators.work import scratch, shared_dir, written
from stratalog.plans.tables import table

_CUT = "1996-01-01"


def _own():
    return [
        F.col("o_custkey").cast("string").alias("kb_id"),
        F.sha2(F.concat_ws("-", "o_custkey", "o_orderpriority"), 256).alias("binary_sha256"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("captured_at"),
    ]


def _batch(orders, lines, late: bool):
    orders, lines = orders.where(F.col("late") == late), lines.where(F.col("late") == late)
    none, own = F.lit(None).cast("string"), _own()
    risk = F.concat(F.lit('{"security":{"risk_score":'), F.floor(F.col("o_totalprice") / 5000), F.lit("}}"))
    heads = orders.select(*own, F.lit("snapshot").alias("kind"), none.alias("category"), F.col("o_orderpriority").alias("name"), risk.alias("value"))
    part = F.col("l_partkey")
    modules = lines.select(*own, F.lit("module").alias("kind"), none.alias("category"), F.concat(F.lit("m"), part).alias("name"), F.concat(F.lit("body "), part % 100).alias("value"))
    category = F.when(F.col("l_returnflag") == "R", "dep").when(F.col("l_returnflag") == "A", "url").otherwise("auth")
    facts = lines.select(*own, F.lit("fact").alias("kind"), category.alias("category"), (part % 20).cast("string").alias("name"), F.col("l_quantity").cast("int").cast("string").alias("value"))
    return heads.unionByName(modules).unionByName(facts)


def _ingested(spark, sf_dir):
    catalogue = ingest.Catalogue(spark, f"{shared_dir(spark)}/catalogue-{uuid.uuid4().hex}")
    orders = table(spark, sf_dir, "orders").withColumn("late", F.col("o_orderdate") >= F.lit(_CUT).cast("timestamp_ntz"))
    with scratch():
        # All batches read the lines of orders: they are joined once.
        lines = orders.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
        lines = written(lines.select("late", "o_custkey", "o_orderpriority", "o_orderdate", "l_partkey", "l_returnflag", "l_quantity"), "lines")
        for batch, late in enumerate((False, True)):
            ingest.ingest(catalogue, _batch(orders, lines, late), batch)
        ingest.ingest(catalogue, _batch(orders, lines, True), 1)  # the batch is marked: nothing is done
        ingest.ingest(catalogue, _batch(orders, lines, False), 2)  # all its contents are known
    return catalogue


def ingested_sources(spark, sf_dir):
    """Snapshots with epoch, risk, depth and counts."""
    rows = _ingested(spark, sf_dir).rows("knowledge_sources")
    return rows.select("kb_id", "epoch", "captured_at", "risk_score", "risk_level", "depth_score", "modules_indexed", "bodies_indexed")


def ingested_diffs(spark, sf_dir):
    """What each epoch's facts changed against those of the epoch before."""
    return _ingested(spark, sf_dir).rows("kb_diffs").select("kb_id", "epoch", "category", "key", "old_value", "new_value", "change_type")


def ingested_totals(spark, sf_dir):
    """Rows of every table as a reader sees it, each key once."""
    c = _ingested(spark, sf_dir)
    seen = {"apps": c.apps(), "bodies": c.rows("module_bodies").select("body_sha256"), "facts": c.facts(), "modules": c.modules(), "refs": c.rows("module_app_refs").drop("batch")}
    return functools.reduce(DataFrame.unionByName, [_counted(name, df) for name, df in seen.items()])


def _counted(name, df):
    """Rows and distinct rows. Digests of rows as they are stored are compared as bytes, half as long as their digits; modules
    come by their digests already, and facts by their snapshots: their distinct rows need no other shuffle."""
    key = [F.unhex(c) if name in ("bodies", "refs") else F.col(c) for c in df.columns]
    return df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.count_distinct(*key).alias("n_distinct"))


QUERIES = {f.__name__: f for f in (ingested_sources, ingested_diffs, ingested_totals)}

_SQL = """o AS (SELECT *, CAST(o_custkey AS VARCHAR) AS kb_id, sha256(o_custkey || '-' || o_orderpriority) AS sha, CAST(epoch(o_orderdate) AS BIGINT) AS cap, o_orderdate >= TIMESTAMP '1996-01-01' AS late FROM orders
        ), first AS (SELECT DISTINCT ON (kb_id, sha) kb_id, sha, cap, late, o_totalprice FROM o ORDER BY kb_id, sha, late, cap, '{"security":{"risk_score":' || CAST(floor(o_totalprice / 5000) AS BIGINT) || '}}'
        ), s AS (SELECT *, CAST(row_number() OVER (PARTITION BY kb_id ORDER BY cap, sha) AS INTEGER) AS epoch, CAST(floor(o_totalprice / 5000) AS BIGINT) AS risk FROM first
        ), l AS (SELECT s.kb_id, s.sha, s.epoch, l_partkey AS p, l_quantity AS q, CASE l_returnflag WHEN 'R' THEN 'dep' WHEN 'A' THEN 'url' ELSE 'auth' END AS category
            FROM s JOIN o ON o.kb_id = s.kb_id AND o.sha = s.sha AND o.late = s.late JOIN lineitem ON l_orderkey = o_orderkey
        ), f AS (SELECT kb_id, epoch, category, CAST(p % 20 AS VARCHAR) AS key, max(CAST(CAST(q AS INTEGER) AS VARCHAR)) AS value FROM l GROUP BY 1, 2, 3, 4)"""
ORACLE_SQL = {
    "ingested_sources": f"""WITH {_SQL}, c AS (SELECT kb_id, epoch, count(DISTINCT p) AS m, count(DISTINCT p % 100) AS b, count(DISTINCT category) AS d FROM l GROUP BY 1, 2)
        SELECT s.kb_id, s.epoch, cap AS captured_at, risk AS risk_score, CASE WHEN risk >= 75 THEN 'critical' WHEN risk >= 50 THEN 'high' WHEN risk >= 25 THEN 'medium' ELSE 'low' END AS risk_level,
               CAST(round(100 * coalesce(d, 0) / 7) AS INTEGER) AS depth_score, coalesce(m, 0) AS modules_indexed, coalesce(b, 0) AS bodies_indexed FROM s LEFT JOIN c ON c.kb_id = s.kb_id AND c.epoch = s.epoch""",
    "ingested_diffs": f"""WITH {_SQL}, n AS (SELECT f.* FROM f WHERE epoch > 1), b AS (SELECT f.kb_id, f.epoch + 1 AS epoch, category, key, value FROM f JOIN s ON s.kb_id = f.kb_id AND s.epoch = f.epoch + 1)
        SELECT coalesce(n.kb_id, b.kb_id) AS kb_id, coalesce(n.epoch, b.epoch) AS epoch, coalesce(n.category, b.category) AS category, coalesce(n.key, b.key) AS key, b.value AS old_value, n.value AS new_value,
               CASE WHEN b.kb_id IS NULL THEN 'added' WHEN n.kb_id IS NULL THEN 'removed' ELSE 'modified' END AS change_type
        FROM n FULL OUTER JOIN b ON n.kb_id = b.kb_id AND n.epoch = b.epoch AND n.category = b.category AND n.key = b.key WHERE n.value IS DISTINCT FROM b.value""",
    "ingested_totals": f"""WITH {_SQL}, t AS (SELECT 'apps' AS name, count(DISTINCT kb_id) AS n FROM s UNION ALL SELECT 'bodies', count(DISTINCT p % 100) FROM l
            UNION ALL SELECT 'facts', count(*) FROM f WHERE (kb_id, epoch) IN (SELECT (kb_id, max(epoch)) FROM s GROUP BY kb_id) UNION ALL SELECT 'modules', count(DISTINCT (kb_id, p % 100)) FROM l
            UNION ALL SELECT 'refs', count(DISTINCT (kb_id, sha, p % 100)) FROM l)
        SELECT name, n AS n_rows, n AS n_distinct FROM t""",
}
