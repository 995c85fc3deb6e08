"""Jobs over whole tables: a copy with new ids, and an export with its checksum."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalog.operators import export, remap
from stratalog.operators.work import shared_dir
from stratalog.plans.tables import table


def _databases(spark, sf_dir):
    """Modules of a source database, and those that the target has of them already under ids of its own."""
    docs = table(spark, sf_dir, "documents")
    source = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("app"), F.sha2("text", 256).alias("body_sha256"), F.col("n_chars").alias("body_size"), (F.col("doc_id") + 100).alias("last_seen_at"))
    one = docs.where("doc_id % 3 = 0").groupBy(F.col("source").alias("app"), F.sha2("text", 256).alias("body_sha256")).agg(F.min("doc_id").alias("least"))
    target = one.select((F.lit(5_000_000) - F.col("least")).alias("id"), "app", "body_sha256", F.lit(-1).cast("long").alias("body_size"), F.lit(400).cast("long").alias("last_seen_at"))
    return source, target


def remap_modules(spark, sf_dir):
    """The target's modules after the copy."""
    source, target = _databases(spark, sf_dir)
    return remap.copy_parents(source, target, remap.id_map(source, target, "id", ["app", "body_sha256"]), "id", "last_seen_at")


def remap_children(spark, sf_dir):
    """Labels under the new ids of their documents, the first of each; the target has some labels of its own."""
    source, target = _databases(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("module_id"), "quality", "toxic")
    own = target.where("id % 2 = 0").select(F.col("id").alias("module_id"), F.lit(9).cast("int").alias("quality"), F.lit(9).cast("int").alias("toxic"))
    return remap.copy_children(labels, own, remap.id_map(source, target, "id", ["app", "body_sha256"]), "module_id", ["module_id"])


def remap_references(spark, sf_dir):
    """Turns of conversations as references between modules: both ends get new ids, an end that wasn't copied is null."""
    source, target = _databases(spark, sf_dir)
    deps = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("from_id"), F.col("role").alias("to_name"), (F.col("conv_id") * 7 + F.col("turn")).alias("to_id"))
    ids = remap.id_map(source, target, "id", ["app", "body_sha256"])
    return remap.copy_children(deps, deps.limit(0), ids, "from_id", ["from_id", "to_name"], optional=["to_id"])


ORDERS = {
    "kb_apps": ["kb_id"], "kb_aliases": ["alias_kb_id"], "knowledge_sources": ["kb_id", "epoch"], "module_app_refs": ["source_id", "body_sha256"], "modules": ["body_sha256"],
    "file_app_refs": ["source_id", "file_sha256"], "files": ["file_sha256"], "app_facts": ["app", "category", "key"], "kb_diffs": ["from_source_id", "to_source_id"],
}


def _tables(spark, sf_dir):
    orders, lines, customer = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "customer"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    sources = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("kb_id"), F.row_number().over(w).alias("epoch"), F.col("o_orderpriority").alias("risk_level"), F.lag("o_orderkey").over(w).alias("before"))
    body, file = F.concat(F.lit("b"), "l_partkey").alias("body_sha256"), F.concat(F.lit("f"), "l_suppkey").alias("file_sha256")
    facts = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("app")), "l_orderkey").groupBy("app", F.col("l_returnflag").alias("category"), F.col("l_partkey").alias("key"))
    return {
        "kb_apps": customer.select(F.col("c_custkey").alias("kb_id"), F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("platform")),
        "kb_aliases": customer.where("c_custkey % 5 = 0").select((F.col("c_custkey") + 1_000_000).alias("alias_kb_id"), F.col("c_custkey").alias("canonical_kb_id")),
        "knowledge_sources": sources.drop("before"),
        "module_app_refs": lines.select(F.col("l_orderkey").alias("source_id"), body).distinct(),
        "modules": table(spark, sf_dir, "part").select(F.concat(F.lit("b"), "p_partkey").alias("body_sha256"), F.col("p_name").alias("name")),
        "file_app_refs": lines.select(F.col("l_orderkey").alias("source_id"), file).distinct(),
        "files": table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), "s_suppkey").alias("file_sha256"), F.col("s_name").alias("path")),
        "app_facts": facts.agg(F.when(F.max("l_quantity") > 25, F.max("l_quantity").cast("int")).alias("value")),
        "kb_diffs": sources.where("before IS NOT NULL").select(F.col("before").alias("from_source_id"), F.col("id").alias("to_source_id"), "risk_level"),
    }


def export_digests(spark, sf_dir):
    """Rows and digest of each table of an export: the applications of a segment and some by their aliases, newest snapshots."""
    customer = table(spark, sf_dir, "customer")
    apps = customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("kb_id")).unionByName(customer.where("c_custkey % 10 = 0").select((F.col("c_custkey") + 1_000_000).alias("kb_id")))
    tables = export.closure(_tables(spark, sf_dir), apps, latest_only=True)
    manifest = export.write_bundle(tables, ORDERS, f"{shared_dir(spark)}/export-{uuid.uuid4().hex}")
    return spark.createDataFrame([(n, manifest["counts"][n], d) for n, d in manifest["digests"].items()], "name string, n_rows long, digest string")


QUERIES = {f.__name__: f for f in (remap_modules, remap_children, remap_references, export_digests)}

_IDS = """src AS (SELECT doc_id AS id, source AS app, sha256(text) AS sha, n_chars, doc_id + 100 AS seen FROM documents
        ), tgt AS (SELECT 5000000 - min(doc_id) AS id, source AS app, sha256(text) AS sha FROM documents WHERE doc_id % 3 = 0 GROUP BY 2, 3
        ), fresh AS (SELECT app, sha, row_number() OVER (ORDER BY app, sha) + (SELECT max(id) FROM tgt) AS id FROM (SELECT DISTINCT app, sha FROM src EXCEPT SELECT app, sha FROM tgt)
        ), ids AS (SELECT src.id AS old_id, coalesce(tgt.id, fresh.id) AS new_id, n_chars, seen FROM src LEFT JOIN tgt ON tgt.app = src.app AND tgt.sha = src.sha
            LEFT JOIN fresh ON fresh.app = src.app AND fresh.sha = src.sha)"""


def _export_sql() -> str:
    """Lines written out by hand, their digests, and digests of a thousand digests until one is left."""
    text = lambda c: f"coalesce('\"' || {c} || '\"', 'null')"
    number = lambda c: f"coalesce(CAST({c} AS VARCHAR), 'null')"
    shapes = {
        "kb_apps": ("kb_id", {"display_name": text, "kb_id": number, "platform": text}, "(SELECT c_custkey AS kb_id, c_name AS display_name, c_mktsegment AS platform FROM customer JOIN wanted ON kb_id = c_custkey)"),
        "kb_aliases": ("alias_kb_id", {"alias_kb_id": number, "canonical_kb_id": number}, "(SELECT kb_id + 1000000 AS alias_kb_id, kb_id AS canonical_kb_id FROM wanted WHERE kb_id % 5 = 0)"),
        "knowledge_sources": ("kb_id, epoch", {"epoch": number, "id": number, "kb_id": number, "risk_level": text}, "chosen"),
        "module_app_refs": ("source_id, body_sha256", {"body_sha256": text, "source_id": number}, "(SELECT DISTINCT l_orderkey AS source_id, 'b' || l_partkey AS body_sha256 FROM lineitem WHERE l_orderkey IN (SELECT id FROM chosen))"),
        "modules": ("body_sha256", {"body_sha256": text, "name": text}, "(SELECT 'b' || p_partkey AS body_sha256, p_name AS name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT id FROM chosen)))"),
        "file_app_refs": ("source_id, file_sha256", {"file_sha256": text, "source_id": number}, "(SELECT DISTINCT l_orderkey AS source_id, 'f' || l_suppkey AS file_sha256 FROM lineitem WHERE l_orderkey IN (SELECT id FROM chosen))"),
        "files": ("file_sha256", {"file_sha256": text, "path": text}, "(SELECT 'f' || s_suppkey AS file_sha256, s_name AS path FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT id FROM chosen)))"),
        "app_facts": ("app, category, key", {"app": number, "category": text, "key": number, "value": number}, "(SELECT o_custkey AS app, l_returnflag AS category, l_partkey AS key, CASE WHEN max(l_quantity) > 25 THEN CAST(max(l_quantity) AS INTEGER) END AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN wanted ON kb_id = o_custkey GROUP BY 1, 2, 3)"),
        "kb_diffs": ("from_source_id, to_source_id", {"from_source_id": number, "risk_level": text, "to_source_id": number}, "(SELECT before AS from_source_id, id AS to_source_id, risk_level FROM snaps WHERE id IN (SELECT id FROM chosen) AND before IN (SELECT id FROM chosen))"),
    }
    lines = []
    for name, (order, fields, of) in shapes.items():
        line = " || ',' || ".join(f"'\"{c}\":' || {how(c)}" for c, how in fields.items())
        lines.append(f"SELECT '{name}' AS name, row_number() OVER (ORDER BY {order}) - 1 AS i, sha256('{{' || {line} || '}}') AS digest FROM {of}")
    return f"""WITH RECURSIVE wanted AS (SELECT DISTINCT c_custkey AS kb_id FROM customer WHERE c_mktsegment = 'BUILDING' OR c_custkey % 10 = 0
        ), snaps AS (SELECT o_orderkey AS id, o_custkey AS kb_id, row_number() OVER w AS epoch, o_orderpriority AS risk_level, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
        ), chosen AS (SELECT id, kb_id, epoch, risk_level FROM snaps JOIN wanted USING (kb_id) QUALIFY row_number() OVER (PARTITION BY kb_id ORDER BY epoch DESC, id DESC) = 1
        ), names AS (SELECT unnest({list(shapes)}) AS name
        ), l AS ({' UNION ALL '.join(lines)}
        ), up AS (SELECT name, i, count(*) OVER (PARTITION BY name) AS n, digest FROM l
            UNION ALL SELECT name, i // 1000, (n + 999) // 1000, sha256(string_agg(digest, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY name, i // 1000, n)
        SELECT names.name, (SELECT count(*) FROM l WHERE l.name = names.name) AS n_rows, coalesce(digest, sha256('')) AS digest FROM names LEFT JOIN up ON up.name = names.name AND n = 1"""


ORACLE_SQL = {
    "remap_modules": f"""WITH {_IDS}, one AS (SELECT new_id AS id, arg_min(n_chars, old_id) AS n_chars, max(seen) AS seen FROM ids GROUP BY 1)
        SELECT one.id, coalesce(tgt.app, fresh.app) AS app, coalesce(tgt.sha, fresh.sha) AS body_sha256, CASE WHEN tgt.id IS NULL THEN n_chars ELSE -1 END AS body_size,
               CASE WHEN tgt.id IS NULL THEN seen ELSE greatest(400, seen) END AS last_seen_at FROM one LEFT JOIN tgt ON tgt.id = one.id LEFT JOIN fresh ON fresh.id = one.id""",
    "remap_children": f"""WITH {_IDS}, own AS (SELECT id AS module_id, 9 AS quality, 9 AS toxic FROM tgt WHERE id % 2 = 0
        ), m AS (SELECT DISTINCT ON (new_id) new_id AS module_id, quality, toxic FROM labels JOIN ids ON old_id = doc_id ORDER BY new_id, quality NULLS FIRST, toxic NULLS FIRST)
        SELECT * FROM own UNION ALL SELECT * FROM m WHERE module_id NOT IN (SELECT module_id FROM own)""",
    "remap_references": f"""WITH {_IDS}, d AS (SELECT f.new_id AS from_id, role AS to_name, t.new_id AS to_id FROM conversations JOIN ids f ON f.old_id = conv_id LEFT JOIN ids t ON t.old_id = conv_id * 7 + turn)
        SELECT DISTINCT ON (from_id, to_name) * FROM d ORDER BY from_id, to_name, to_id NULLS FIRST""",
    "export_digests": _export_sql(),
}


def knowledge_folders(spark, sf_dir):
    """Files of the knowledge folders of orders: which there are, and what they hold."""
    lines = table(spark, sf_dir, "lineitem")
    k, number = F.col("l_orderkey"), F.sort_array(F.collect_list("l_partkey"))
    parts = lines.groupBy("l_orderkey").agg(F.to_json(number).alias("ps"), F.count("*").alias("n"))
    doc = F.concat(
        F.lit('{"communication":'), F.when(k % 3 == 0, "null").otherwise(F.concat(F.lit('{"endpoints":'), F.col("ps"), F.lit("}"))), F.when(k % 2 == 0, F.concat(F.lit(',"ui":{"routes":'), F.col("n"), F.lit("}"))).otherwise(""),
        F.when(k % 5 == 0, ',"npm":{"network_calls":[]}').when(k % 5 == 1, F.concat(F.lit(',"npm":{"network_calls":'), F.col("ps"), F.lit("}"))).otherwise(""), F.lit("}"),
    )
    return export.knowledge_files(parts.select("l_orderkey", doc.alias("doc")), "l_orderkey", "doc")


QUERIES["knowledge_folders"] = knowledge_folders
ORACLE_SQL["knowledge_folders"] = """WITH p AS (SELECT l_orderkey AS k, '[' || string_agg(l_partkey, ',' ORDER BY l_partkey) || ']' AS ps, count(*) AS n FROM lineitem GROUP BY 1
    ), d AS (SELECT k, ps, n, '{"communication":' || CASE WHEN k % 3 = 0 THEN 'null' ELSE '{"endpoints":' || ps || '}' END AS c, CASE k % 5 WHEN 0 THEN ',"npm":{"network_calls":[]}' WHEN 1 THEN ',"npm":{"network_calls":' || ps || '}' ELSE '' END AS m,
        CASE WHEN k % 2 = 0 THEN ',"ui":{"routes":' || n || '}' ELSE '' END AS u FROM p)
    SELECT k AS app, 'knowledge.json' AS file, c || m || u || '}' AS content FROM d UNION ALL SELECT k, 'communication/endpoints.json', ps FROM d WHERE k % 3 <> 0
    UNION ALL SELECT k, 'ui/framework.json', '{"routes":' || n || '}' FROM d WHERE k % 2 = 0 UNION ALL SELECT k, 'ui/routes.json', CAST(n AS VARCHAR) FROM d WHERE k % 2 = 0
    UNION ALL SELECT k, 'npm/metadata.json', CASE k % 5 WHEN 0 THEN '{"network_calls":[]}' ELSE '{"network_calls":' || ps || '}' END FROM d WHERE k % 5 < 2 UNION ALL SELECT k, 'npm/api-calls.json', ps FROM d WHERE k % 5 = 1"""
