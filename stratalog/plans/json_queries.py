"""Queries on JSON documents that stand on orders and their lines: facts, risk, pieces, overlays, equality."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.operators import json_docs as J
from stratalog.plans.tables import table


def documents(spark, sf_dir):
    """(id, doc): one JSON document an order. What it holds depends on the order's key and lines, so that every path of
    the extraction occurs: strings beside objects, names that are missing or empty, numbers as text, nested scores."""
    part = F.concat(F.lit("part-"), "l_partkey")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    number = F.col("l_quantity").cast("int").cast("string")
    dep = (
        F.when(F.col("l_linenumber") == 1, quoted(part))
        .when(F.col("l_returnflag") == "R", F.concat(F.lit('{"version":"'), number, F.lit('","name":'), quoted(part), F.lit("}")))
        .when(F.col("l_returnflag") == "A", F.concat(F.lit('{"qty":'), number, F.lit(',"name":'), quoted(part), F.lit("}")))
        .otherwise(F.lit('{"name":"","version":"1"}'))
    )
    url = F.concat(F.lit('"https://s'), F.col("l_suppkey") % 7, F.lit(".example.com/p/"), "l_partkey", F.lit('?q=1"'))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", dep.alias("dep"), url.alias("url")))).alias("ls")
    )
    k = F.col("o_orderkey")
    score = F.floor(F.col("o_totalprice") / 5000).cast("int")
    security = (
        F.when(k % 4 == 0, F.concat(F.lit('"uwp_analyze":{"score":{"value":'), score, F.lit(',"level":"'), F.when(k % 8 == 0, "odd").otherwise(""), F.lit('"},"capabilities":[{"namespace":"uap","name":"net"},"raw",{"name":"cam"},7]},')))
        .when(k % 4 == 1, F.concat(F.lit('"security":{"risk_score":'), score, F.lit(',"auth":"oauth2"},')))
        .when(k % 4 == 2, F.concat(F.lit('"android_manifest":{"security_score":'), score, F.lit(',"permissions":["CAMERA","",null,"SMS"]},')))
        .otherwise(F.lit('"security":{"risk_score":"12","auth":""},"auth":{"providers":["saml",{"name":"google","id":1},{"id":2}],"schemes":["basic"]},'))
    )
    cert = F.concat(F.lit('"certificates":[{"subject":"CN='), F.col("o_custkey"), F.lit('"},{"fingerprint":"'), F.sha2(k.cast("string"), 256), F.lit('"},{"x":1}],'))
    joined = lambda f: F.array_join(F.transform("ls", lambda x: x[f]), ",")
    doc = F.concat(
        F.lit("{"), security, cert, F.lit('"framework":'), quoted(F.when(k % 3 == 0, "").otherwise(F.col("o_orderpriority"))),
        F.lit(',"dependencies":['), joined("dep"), F.lit('],"network":{"endpoints":['), joined("url"), F.lit("]}}"),
    )
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey").select(k.alias("id"), doc.alias("doc"), "o_custkey", "o_totalprice")


def json_facts(spark, sf_dir):
    """Facts of every document in seven categories."""
    return J.extract_facts(documents(spark, sf_dir), "id", "doc")


def json_risk(spark, sf_dir):
    """Risk score and level of every document by precedence of the paths; unknown without a score."""
    rows = documents(spark, sf_dir).select("id", J.risk(F.parse_json("doc")).alias("r"))
    return rows.select("id", "r.score", F.coalesce("r.level", F.lit("unknown")).alias("level"))


def json_pieces(spark, sf_dir):
    """Documents in pieces of at most 120 characters, but for arrays, counted by path."""
    found = J.pieces(documents(spark, sf_dir), "id", "doc", 120)
    return found.groupBy("path").agg(F.count("*").alias("n"))


def json_leaves(spark, sf_dir):
    """Leaves of the payloads of events."""
    return J.pieces(table(spark, sf_dir, "events").select("event_id", "props"), "event_id", "props")


def json_overlay(spark, sf_dir):
    """Payloads of errors (static) overlaid by those of the user's other events of the same command, counted by provenance."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type") == "error", F.to_json(F.struct(F.struct(F.lit(1).alias("v"), F.col("event_type").alias("t")).alias("a"), F.col("user_id").alias("u"))).alias("doc"))
    rows = rows.toDF("id", "failed", "doc")
    one = lambda f: rows.where(F.col("failed") == f).groupBy("id").agg(F.min("doc").alias("doc"))
    merged = J.overlay_leaves(one(True), one(False), "id", "doc")
    return merged.groupBy("path", "provenance").agg(F.count("*").alias("n"), F.count("static_value").alias("archived"))


def json_equal(spark, sf_dir):
    """Orders whose document equals one with its fields in another order; those divisible by five differ in a value."""
    a = F.concat(F.lit('{"p": "'), "o_orderpriority", F.lit('", "k": {"b": 1, "a": '), F.col("o_custkey"), F.lit("}}"))
    b = F.concat(F.lit('{"k":{"a":'), F.col("o_custkey") + (F.col("o_orderkey") % 5 == 0).cast("int"), F.lit(',"b":1},"p":"'), "o_orderpriority", F.lit('"}'))
    return table(spark, sf_dir, "orders").select("o_orderkey", J.same_json(a, b).alias("same"))


def json_objects(spark, sf_dir):
    """Dependencies that are objects, and elements of the first array among the usual fields, of every document."""
    v = F.parse_json("doc")
    return documents(spark, sf_dir).select("id", F.size(J.objects_of(v, "$.dependencies")).alias("objects"), F.size(J.first_array(J.part(v, "$.network"))).alias("generic"))


QUERIES = {f.__name__: f for f in (json_facts, json_risk, json_pieces, json_leaves, json_overlay, json_equal, json_objects)}

_SCORE = "CAST(floor(o_totalprice / 5000) AS INTEGER)"
_LEVEL = f"CASE WHEN {_SCORE} >= 75 THEN 'critical' WHEN {_SCORE} >= 50 THEN 'high' WHEN {_SCORE} >= 25 THEN 'medium' ELSE 'low' END"
_ORDERS = "o AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"

ORACLE_SQL = {
    "json_facts": f"""WITH {_ORDERS}, l AS (SELECT l_orderkey AS id, l_linenumber AS n, l_returnflag AS flag, l_partkey, l_suppkey, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS qty,
                   'part-' || l_partkey AS part FROM lineitem)
        SELECT o_orderkey AS id, 'framework' AS category, 'name' AS key, o_orderpriority AS value FROM o WHERE o_orderkey % 3 <> 0
        UNION ALL SELECT id, 'dep', part, CASE WHEN n = 1 THEN part WHEN flag = 'R' THEN part || '@' || qty
                                               ELSE '{{"name":"' || part || '","qty":' || qty || '}}' END FROM l WHERE n = 1 OR flag IN ('R', 'A')
        UNION ALL SELECT id, 'url', 's' || (l_suppkey % 7) || '.example.com', 'https://s' || (l_suppkey % 7) || '.example.com/p/' || l_partkey || '?q=1' FROM l
        UNION ALL SELECT o_orderkey, 'capability', k, v FROM o, (VALUES (0, 'uap:net', '{{"name":"net","namespace":"uap"}}'), (0, 'cam', '{{"name":"cam"}}'), (0, 'raw', 'raw'),
                         (2, 'CAMERA', 'CAMERA'), (2, 'SMS', 'SMS')) t(m, k, v) WHERE o_orderkey % 4 = m
        UNION ALL SELECT o_orderkey, 'cert', substr('CN=' || o_custkey, 1, 16), '{{"subject":"CN=' || o_custkey || '"}}' FROM o
        UNION ALL SELECT o_orderkey, 'cert', substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16), '{{"fingerprint":"' || sha256(CAST(o_orderkey AS VARCHAR)) || '"}}' FROM o
        UNION ALL SELECT o_orderkey, 'risk', 'risk-score', {_SCORE} || ':' || CASE WHEN o_orderkey % 8 = 0 THEN 'odd' ELSE {_LEVEL} END FROM o WHERE o_orderkey % 4 <> 3
        UNION ALL SELECT o_orderkey, 'auth', k, v FROM o, (VALUES (1, 'scheme', 'oauth2'), (3, 'saml', 'saml'), (3, 'google', '{{"id":1,"name":"google"}}'), (3, 'basic', 'basic')) t(m, k, v)
                  WHERE o_orderkey % 4 = m""",
    "json_risk": f"""WITH {_ORDERS}
        SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 3 THEN CAST({_SCORE} AS BIGINT) END AS score,
               CASE WHEN o_orderkey % 4 = 3 THEN 'unknown' WHEN o_orderkey % 8 = 0 THEN 'odd' ELSE {_LEVEL} END AS level FROM o""",
    "json_pieces": f"""WITH {_ORDERS}, c AS (SELECT o_orderkey AS k, {_SCORE} AS score, (SELECT sum(length('"https://s' || (l_suppkey % 7) || '.example.com/p/' || l_partkey || '?q=1"') + 1) - 1
                   FROM lineitem WHERE l_orderkey = o_orderkey) AS urls FROM o), p AS (
            SELECT unnest(['certificates', 'framework', 'dependencies', CASE WHEN urls + 16 > 120 THEN 'network > endpoints' ELSE 'network' END]) AS path FROM c
            UNION ALL SELECT 'security' FROM c WHERE k % 4 IN (1, 3) UNION ALL SELECT 'auth' FROM c WHERE k % 4 = 3 UNION ALL SELECT 'android_manifest' FROM c WHERE k % 4 = 2
            UNION ALL SELECT CASE WHEN length('{{"capabilities":[{{"name":"net","namespace":"uap"}},"raw",{{"name":"cam"}},7],"score":{{"level":"' || CASE WHEN k % 8 = 0 THEN 'odd' ELSE '' END || '","value":' || score || '}}}}') > 120
                                  THEN 'split' ELSE 'uwp_analyze' END FROM c WHERE k % 4 = 0)
        SELECT path, count(*) AS n FROM p GROUP BY path""",
    "json_leaves": """SELECT event_id, 'k' AS path, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events""",
    "json_overlay": """WITH m AS (SELECT user_id, event_type = 'error' AS failed, min(event_type) AS t FROM events GROUP BY 1, 2), b AS (
            SELECT coalesce(s.user_id, x.user_id) AS id, s.t AS st, x.t AS lt FROM (SELECT * FROM m WHERE failed) s FULL OUTER JOIN (SELECT * FROM m WHERE NOT failed) x ON s.user_id = x.user_id
        ), p AS (SELECT *, CASE WHEN lt IS NULL THEN 'static' WHEN st IS NULL THEN 'live' ELSE 'both' END AS provenance, unnest(['a > v', 'a > t', 'u']) AS path FROM b)
        SELECT path, provenance, count(*) AS n, count(*) FILTER (WHERE path = 'a > t' AND lt <> st) AS archived FROM p GROUP BY 1, 2""",
    "json_equal": "SELECT o_orderkey, o_orderkey % 5 <> 0 AS same FROM orders",
    "json_objects": """SELECT l_orderkey AS id, CAST(count(*) FILTER (WHERE l_linenumber <> 1) AS INTEGER) AS objects, CAST(count(*) AS INTEGER) AS generic FROM lineitem
        WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1""",
}
