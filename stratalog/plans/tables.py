"""Readers of the driver tables and the catalogue tables that stand on them, with the SQL of the latter.

``modules`` stands on ``documents``: one document is one module, its source is the application, and the SHA-256 of its
text is the content hash that propagation and reuse work by. ``snapshots`` stands on ``orders``: a customer is a
catalogue entry and its orders, by date, are its epochs; ``facts`` are the order's lines. ``attempts`` and usage events
stand on ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modules(spark: SparkSession, sf_dir: str, labels: bool = True) -> DataFrame:
    """id, app, lang, body, body_size, body_sha256; with ``labels`` quality and toxic (null where there is none)."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("app"),
        "lang",
        F.col("text").alias("body"),
        F.col("n_chars").alias("body_size"),
        F.sha2("text", 256).alias("body_sha256"),
    )
    if not labels:
        return docs
    return docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic"), "id", "left")


MODULES_SQL = """modules AS (
    SELECT d.doc_id AS id, d.source AS app, d.lang, d.text AS body, d.n_chars AS body_size, sha256(d.text) AS body_sha256,
           l.quality, l.toxic
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kb_id, epoch, captured_at, risk_level."""
    newest = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("kb_id"),
        F.row_number().over(newest).alias("epoch"),
        F.col("o_orderdate").alias("captured_at"),
        F.col("o_orderpriority").alias("risk_level"),
        F.col("o_totalprice").alias("depth_score"),
    )


SNAPSHOTS_SQL = """snapshots AS (
    SELECT o_orderkey AS id, o_custkey AS kb_id,
           CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS epoch,
           o_orderdate AS captured_at, o_orderpriority AS risk_level, o_totalprice AS depth_score
    FROM orders)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kb_id, epoch, category, key, value: one value for each key of a snapshot."""
    lines = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("category"), F.col("l_partkey").alias("key")
    )
    lines = lines.agg(F.max("l_quantity").alias("value"))
    return lines.join(snapshots(spark, sf_dir).select("id", "kb_id", "epoch"), "id").drop("id")


FACTS_SQL = (
    SNAPSHOTS_SQL
    + """, facts AS (
    SELECT s.kb_id, s.epoch, l.l_returnflag AS category, l.l_partkey AS key, max(l.l_quantity) AS value
    FROM lineitem l JOIN snapshots s ON s.id = l.l_orderkey GROUP BY ALL)"""
)


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the command (field k of the payload) that they belong to."""
    return table(spark, sf_dir, "events").withColumn("cmd", F.get_json_object("props", "$.k").cast("int"))


USAGE_SQL = "usage AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS cmd FROM events)"
