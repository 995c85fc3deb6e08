"""Queries that search the catalogue over several tables, list its parts and pick what is to be worked on.

Modules are parts, their references the lines of orders, snapshots the orders and applications the customers.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stratalog.functions import score as S
from stratalog.functions import text as X
from stratalog.operators import changes, keys, search, texts
from stratalog.plans.tables import modules, table
from stratalog.plans.text_queries import _similar

SINCE = dt.datetime(1997, 1, 1)


def _catalogue(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    text = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    mods = part.select(F.col("p_partkey").alias("module_id"), F.col("p_name").alias("name"), text.alias("search_text"), F.col("p_partkey").alias("body"))
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("body"), F.col("l_orderkey").alias("source_id")).distinct()
    sources = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"), F.col("o_custkey").alias("kb_id"), F.col("o_orderdate").alias("captured_at"))
    apps = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("kb_id"), F.col("c_name").alias("display_name"))
    components = part.where("p_size > 25").select(F.col("p_partkey").alias("module_id"), F.col("p_brand").alias("component"))
    enrichment = part.where("p_size % 3 = 0").select(F.col("p_partkey").alias("module_id"), F.col("p_type").alias("role"))
    return mods, refs, sources, apps, components, enrichment


def search_ranked_joined(spark, sf_dir):
    """The first page of a search over modules, references, snapshots and applications, with component and role."""
    found = search.ranked_search(*_catalogue(spark, sf_dir), "red ring", since=SINCE, limit=100, least=0.35)
    return found.select("module_id", F.round("sim", 9).alias("sim"), "kb_id", "display_name", "captured_at", "source_id", "component", "role")


def search_by_component(spark, sf_dir):
    """The same within one component, behind a cursor."""
    found = search.ranked_search(*_catalogue(spark, sf_dir), "ring", component="Brand#13", after=(0.4, SINCE, 0), limit=0, least=0.05)
    return found.select("module_id", F.round("sim", 9).alias("sim"), "kb_id", "captured_at", "source_id", "component")


def chunk_search_joined(spark, sf_dir):
    """Paragraphs that mention a licence with document, snapshot, application and nation: five tables."""
    hits = texts.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text").where(X.contains_ci(F.col("text"), "licensed under"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    snaps = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey", "o_orderdate")
    apps = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    found = hits.join(docs, "doc_id").join(snaps, "doc_id").join(apps, "o_custkey").join(nations, "c_nationkey")
    return found.select("doc_id", "line", "source", "o_orderdate", "c_name", "n_name", X.snippet(F.col("text"), "licensed").alias("snippet"))


def apps_list(spark, sf_dir):
    """Applications of one platform with one of two tags, seen last first, never seen ones last; optional filters left open."""
    customer = table(spark, sf_dir, "customer")
    tags = F.array(F.lower("c_mktsegment"), F.concat(F.lit("n"), F.col("c_nationkey") % 5))
    latest = keys.latest(table(spark, sf_dir, "orders"), "o_custkey", F.struct("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderpriority"])
    rows = customer.select("c_custkey", "c_name", "c_mktsegment", tags.alias("tags")).join(latest.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
    rows = rows.where(search.optional(F.col("c_name"), None) & search.overlaps(F.col("tags"), ["n1", "n3"]) & search.overlaps(F.col("tags"), None))
    rows = rows.where(search.optional(F.col("c_mktsegment"), "BUILDING"))
    return rows.orderBy(F.desc_nulls_last("o_orderdate"), "c_custkey").limit(100).select("c_custkey", "c_name", "o_orderdate", "o_orderpriority")


def _app_facts(spark, sf_dir):
    value = F.when(F.max("l_quantity") > 25, F.max("l_quantity").cast("int").cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("app"), F.col("l_returnflag").alias("category"), F.col("l_partkey").alias("key")).agg(value.alias("value"))


def facts_filled(spark, sf_dir):
    return _app_facts(spark, sf_dir).where("value IS NOT NULL AND category = 'R'").orderBy("app", "category", "key").limit(1000)


def facts_gaps(spark, sf_dir):
    return _app_facts(spark, sf_dir).where("value IS NULL").orderBy("app", "category", "key").limit(1000)


def pending_modules(spark, sf_dir):
    """Modules without a summary, the smallest ids first; labels stand for summaries, and class 0 for empty ones."""
    rows = modules(spark, sf_dir).withColumn("summary", F.when(F.col("quality") == 0, "").when(F.col("quality") == 1, "done"))
    return rows.where("summary IS NULL OR summary = ''").orderBy("id").limit(500).select("id", "app")


# Names that say nothing.
PLACEHOLDER, HEXADECIMAL = "^teams_module_[0-9]+$", "^[0-9a-fA-F]{8,}$"


def eligible_modules(spark, sf_dir):
    """One module of each content with a name that says something, or a synthetic one; toxic ones are left out."""
    which = F.col("id") % 5
    name = (
        F.when(which == 0, F.concat(F.lit("teams_module_"), "id")).when(which == 1, F.substring("body_sha256", 1, 10)).when(which == 2, "ab")
        .when(which == 3, F.concat(F.lit("Widget"), "id")).otherwise("12345")
    )
    sha = F.when(F.col("id") % 7 == 0, "").otherwise(F.col("body_sha256"))
    rows = modules(spark, sf_dir).where("coalesce(toxic, 0) = 0").select("id", "app", name.alias("name"), F.when(F.col("id") % 10 == 0, "Synth").alias("synthetic"), sha.alias("sha"))
    named = ~F.col("name").rlike(PLACEHOLDER) & ~F.col("name").rlike(HEXADECIMAL) & F.col("name").rlike("[A-Za-z]") & (F.length("name") >= 3)
    rows = rows.where(named | (F.coalesce("synthetic", F.lit("")) != ""))
    return keys.once_per_content(rows, "sha", "id").orderBy("id").limit(500).select("id", "app", "name")


def module_sightings(spark, sf_dir):
    """How often each module was seen; 0 where never."""
    seen = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").join(seen, "p_partkey", "left").select("p_partkey", "p_name", F.coalesce("n", F.lit(0)).alias("sightings"))


def export_closure(spark, sf_dir):
    """Modules that belong to an export of one segment's applications: nested memberships as semi joins."""
    apps = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    snaps = table(spark, sf_dir, "orders").join(apps, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    bodies = table(spark, sf_dir, "lineitem").join(snaps, "l_orderkey", "left_semi").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(bodies, "p_partkey", "left_semi").select("p_partkey", "p_name")


def run_singletons(spark, sf_dir):
    """One row of a run's numbers from three tables of one row each; an empty table still gives its zero."""
    events = table(spark, sf_dir, "events")
    run = events.agg(F.count("*").alias("attempts"), F.count_if(F.col("event_type") == "error").alias("failed"))
    mods = modules(spark, sf_dir).agg(F.count("quality").alias("summarised"), F.count_if(F.col("toxic") == 1).alias("flagged"))
    cost = table(spark, sf_dir, "lineitem").agg(F.coalesce(F.sum(F.floor("l_quantity")), F.lit(0)).alias("units"))
    one = run.crossJoin(mods).crossJoin(cost)  # of one row each
    return one.withColumn("failure_rate", S.ratio(F.col("failed"), F.col("attempts")))


def dependency_vulnerabilities(spark, sf_dir):
    """Findings of each dependency, joined on ecosystem, name and version and grouped back; none is an empty list."""
    deps = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("eco"), F.col("p_type").alias("name"), F.col("p_size").alias("version"))
    found = table(spark, sf_dir, "part").where("p_partkey % 11 = 0").select(F.col("p_brand").alias("eco"), F.col("p_type").alias("name"), F.col("p_size").alias("version"), F.concat(F.lit("V-"), "p_partkey").alias("vuln"))
    hits = found.groupBy("eco", "name", "version").agg(F.array_join(F.sort_array(F.collect_set("vuln")), ",").alias("vulns"))
    return deps.join(hits, ["eco", "name", "version"], "left").select("p_partkey", F.coalesce("vulns", F.lit("")).alias("vulns"))


def evidence_pick(spark, sf_dir):
    """The three shortest texts of each source that hold a word: a rank limit that Spark applies before the shuffle too."""
    rows = table(spark, sf_dir, "documents").where(X.contains_ci(F.col("text"), "licensed")).select("doc_id", "source", F.length("text").alias("chars"))
    return changes.first_of_group(rows, ["source"], ["chars", "doc_id"], 3).select("source", "doc_id", "chars")


def random_sample(spark, sf_dir):
    """Ten documents in an order that a seed fixes."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return rows.orderBy(F.md5(F.concat(F.lit("7:"), "doc_id")), "doc_id").limit(10)


QUERIES = {
    f.__name__: f
    for f in (
        search_ranked_joined, search_by_component, chunk_search_joined, apps_list, facts_filled, facts_gaps, pending_modules,
        eligible_modules, module_sightings, export_closure, run_singletons, dependency_vulnerabilities, evidence_pick, random_sample,
    )
}


def _joined(query: str, least: float) -> str:
    return f"""m AS (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS txt, p_size, p_brand, p_type FROM part
        ), s AS (SELECT *, {_similar('txt', f"'{query}'")} AS sim FROM m
        ), h AS (SELECT * FROM s WHERE sim >= {least} OR txt ILIKE '%{query}%'
        ), j AS (SELECT p_partkey AS module_id, sim, c_custkey AS kb_id, c_name AS display_name, o_orderdate AS captured_at, o_orderkey AS source_id,
                   CASE WHEN p_size > 25 THEN p_brand ELSE 'other' END AS component, CASE WHEN p_size % 3 = 0 THEN p_type ELSE '' END AS role
            FROM h JOIN (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)"""


_FACTS = """f AS (SELECT l_suppkey AS app, l_returnflag AS category, l_partkey AS key,
            CASE WHEN max(l_quantity) > 25 THEN CAST(CAST(max(l_quantity) AS INTEGER) AS VARCHAR) END AS value FROM lineitem GROUP BY 1, 2, 3)"""

ORACLE_SQL = {
    "search_ranked_joined": f"""WITH {_joined('red ring', 0.35)}
        SELECT module_id, round(sim, 9) AS sim, kb_id, display_name, captured_at, source_id, component, role FROM j
        WHERE captured_at >= TIMESTAMP '1997-01-01' ORDER BY j.sim DESC, captured_at DESC, module_id LIMIT 100""",
    "search_by_component": f"""WITH {_joined('ring', 0.05)}
        SELECT module_id, round(sim, 9) AS sim, kb_id, captured_at, source_id, component FROM j WHERE component = 'Brand#13'
          AND (sim < 0.4 OR (sim = 0.4 AND (captured_at < TIMESTAMP '1997-01-01' OR (captured_at = TIMESTAMP '1997-01-01' AND module_id > 0))))
        ORDER BY j.sim DESC, captured_at DESC, module_id LIMIT 500""",
    "chunk_search_joined": """WITH l AS (
            SELECT doc_id, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)
        SELECT doc_id, CAST(line AS INTEGER) AS line, source, o_orderdate, c_name, n_name, substr(text, greatest(1, instr(lower(text), 'licensed') - 16), 64) AS snippet
        FROM l JOIN orders ON o_orderkey = doc_id JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE text ILIKE '%licensed under%'""",
    "apps_list": """SELECT c_custkey, c_name, o.o_orderdate, o.o_orderpriority FROM customer c
        LEFT JOIN LATERAL (SELECT o_orderdate, o_orderpriority FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) o ON true
        WHERE c_mktsegment = 'BUILDING' AND list_has_any([lower(c_mktsegment), 'n' || (c_nationkey % 5)], ['n1', 'n3'])
        ORDER BY o.o_orderdate DESC NULLS LAST, c_custkey LIMIT 100""",
    "facts_filled": f"WITH {_FACTS} SELECT * FROM f WHERE value IS NOT NULL AND category = 'R' ORDER BY app, category, key LIMIT 1000",
    "facts_gaps": f"WITH {_FACTS} SELECT * FROM f WHERE value IS NULL ORDER BY app, category, key LIMIT 1000",
    "pending_modules": """SELECT d.doc_id AS id, source AS app FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
        WHERE quality IS NULL OR quality = 0 ORDER BY d.doc_id LIMIT 500""",
    "eligible_modules": """WITH m AS (SELECT d.doc_id AS id, source AS app, sha256(text) AS h, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
        ), n AS (SELECT id, app, CASE id % 5 WHEN 0 THEN 'teams_module_' || id WHEN 1 THEN substr(h, 1, 10) WHEN 2 THEN 'ab' WHEN 3 THEN 'Widget' || id ELSE '12345' END AS name,
                   CASE WHEN id % 7 = 0 THEN 'id:' || id ELSE 'sha:' || h END AS k FROM m WHERE toxic IS DISTINCT FROM 1)
        SELECT id, app, name FROM (SELECT DISTINCT ON (k) id, app, name FROM n WHERE id % 5 = 3 OR id % 10 = 0 ORDER BY k, id) ORDER BY id LIMIT 500""",
    "module_sightings": """SELECT p_partkey, p_name, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS sightings FROM part""",
    "export_closure": """SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey IN (
            SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000)))""",
    "run_singletons": """SELECT attempts, failed, summarised, flagged, units, failed / attempts AS failure_rate
        FROM (SELECT count(*) AS attempts, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events),
             (SELECT count(quality) AS summarised, count(*) FILTER (WHERE toxic = 1) AS flagged FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
             (SELECT CAST(sum(floor(l_quantity)) AS BIGINT) AS units FROM lineitem)""",
    "dependency_vulnerabilities": """SELECT d.p_partkey, coalesce(string_agg(DISTINCT 'V-' || v.p_partkey, ',' ORDER BY 'V-' || v.p_partkey), '') AS vulns FROM part d
        LEFT JOIN part v ON v.p_partkey % 11 = 0 AND v.p_brand = d.p_brand AND v.p_type = d.p_type AND v.p_size = d.p_size GROUP BY 1""",
    "evidence_pick": """SELECT source, doc_id, CAST(length(text) AS INTEGER) AS chars FROM documents WHERE text ILIKE '%licensed%'
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(text), doc_id) <= 3""",
    "random_sample": "SELECT doc_id, source FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 10",
}
