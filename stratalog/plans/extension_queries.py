"""Queries through the extension points, and merges of several sources by name and alias."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.functions import text as X
from stratalog.operators import matching
from stratalog.operators import registries as R
from stratalog.plans.tables import table


def classified_pages(spark, sf_dir):
    """Labels of pages by the first of three classifiers that can tell."""
    classifiers = R.Registry()
    classifiers.register("override", lambda: F.when(F.col("page_id") % 17 == 0, "pinned"))
    classifiers.register("path", lambda: F.when(X.url_path(F.col("url")).endswith(".html"), "document"))
    classifiers.register("host", lambda: F.when(X.url_host(F.col("url")).startswith("www."), "site"))
    return table(spark, sf_dir, "pages").select("page_id", R.first_label(classifiers).alias("label"))


def dimension_scores(spark, sf_dir):
    """Scores of orders in three dimensions, bounded."""
    scorers = R.Registry()
    scorers.register("price", lambda: F.floor(F.col("o_totalprice") / 1000))
    scorers.register("age", lambda: F.year("o_orderdate") - 1994)
    scorers.register("urgency", lambda: F.when(F.col("o_orderpriority") == "1-URGENT", 80))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(R.scorecard(scorers)).alias("s"))
    return rows.select("o_orderkey", "s.dimension", "s.score")


def package_ids(spark, sf_dir):
    """Identifiers of parts by the resolver of their ecosystem; its name elsewhere."""
    resolvers = R.Registry()
    resolvers.register("npm", lambda: F.concat(F.lit("@scope/"), X.slug(F.col("p_name"))))
    resolvers.register("maven", lambda: F.concat_ws(":", F.lower("p_brand"), X.slug(F.col("p_name"))))
    eco = F.element_at(F.array(F.lit("npm"), F.lit("maven"), F.lit("go")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", R.package_id(resolvers, eco, F.col("p_name")).alias("package_id"))


def analyzed_rows(spark, sf_dir):
    """Rows of an analyzer and of a supplement for orders, counted by kind."""
    R.ANALYZERS.register("orders", lambda rows: rows.select("o_orderkey", F.col("o_orderstatus").alias("finding")))
    R.SUPPLEMENTS.register("urgent", lambda rows: rows.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit("urgent").alias("finding")))
    return R.analyze(table(spark, sf_dir, "orders"), "orders").groupBy("finding").agg(F.count("*").alias("n"))


def source_merge(spark, sf_dir):
    """Findings of a spine with aliases, folded with two sources by any alias, and those that only a third one has."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    spine = part.where("p_partkey % 4 <> 3").select(
        F.concat(F.lit("V-"), key).alias("id"), F.array(F.concat(F.lit("C-"), key), F.when(key % 2 == 0, F.concat(F.lit("G-"), key)).otherwise("")).alias("aliases")
    )
    nvd = part.where("p_partkey % 3 = 0").select(F.concat(F.lit("C-"), key).alias("alias"), F.col("p_brand").alias("value"))
    ghsa = part.where("p_partkey % 4 = 2").select(F.concat(F.lit("G-"), key).alias("alias"), F.col("p_type").alias("value"))
    local = part.where("p_partkey % 5 = 0").select(F.concat(F.lit("C-"), key).alias("alias"))
    merged = matching.merge_sources(spine, {"nvd": nvd, "ghsa": ghsa}, "local", local)
    return merged.select("id", F.array_join("sources", ",").alias("sources"), F.array_join("values", "|").alias("values"))


def name_tricks(spark, sf_dir):
    """Names made of known ones by tricks: hyphens left out, letters repeated, affixes, other scopes, other alphabets."""
    known = table(spark, sf_dir, "nation").select(F.concat(F.lit("vis-ual-lib-"), F.char(F.col("n_nationkey") + 97), F.lit("q")).alias("known"))
    forms = F.array(F.regexp_replace("known", "-", ""), F.regexp_replace("known", "i", "iii"), F.concat("known", F.lit("-helper")), F.concat(F.lit("get-"), "known"), F.concat(F.lit("@evil/"), "known"), F.regexp_replace("known", "a", "а"), F.col("known"))
    names = known.select(F.col("known").alias("made_of"), F.posexplode(forms).alias("form", "name"))
    found = matching.name_tricks(names.select("name").distinct(), known, "name", "known")
    return found.select("name", "known", "method")


QUERIES = {f.__name__: f for f in (classified_pages, dimension_scores, package_ids, analyzed_rows, source_merge, name_tricks)}

_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"
_PATH = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_SLUG = "trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-')"

ORACLE_SQL = {
    "classified_pages": f"""SELECT page_id, CASE WHEN page_id % 17 = 0 THEN 'pinned' WHEN suffix({_PATH}, '.html') THEN 'document' WHEN prefix({_HOST}, 'www.') THEN 'site' ELSE 'unknown' END AS label FROM pages""",
    "dimension_scores": """SELECT o_orderkey, unnest(['price', 'age', 'urgency']) AS dimension, unnest([CAST(least(greatest(floor(o_totalprice / 1000), 0), 100) AS INTEGER),
               CAST(least(greatest(year(o_orderdate) - 1994, 0), 100) AS INTEGER), CASE WHEN o_orderpriority = '1-URGENT' THEN 80 ELSE 0 END]) AS score FROM orders""",
    "package_ids": f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '@scope/' || {_SLUG} WHEN 1 THEN lower(p_brand) || ':' || {_SLUG} ELSE p_name END AS package_id FROM part""",
    "analyzed_rows": """SELECT o_orderstatus AS finding, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'urgent', count(*) FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "source_merge": """SELECT 'V-' || p_partkey AS id, concat_ws(',', CASE WHEN p_partkey % 4 = 2 THEN 'ghsa' END, CASE WHEN p_partkey % 5 = 0 THEN 'local' END, CASE WHEN p_partkey % 3 = 0 THEN 'nvd' END, 'spine') AS sources,
               array_to_string(list_sort(list_filter([CASE WHEN p_partkey % 3 = 0 THEN p_brand END, CASE WHEN p_partkey % 4 = 2 THEN p_type END], lambda x: x IS NOT NULL)), '|') AS values
        FROM part WHERE p_partkey % 4 <> 3
        UNION ALL SELECT 'C-' || p_partkey, 'local', '' FROM part WHERE p_partkey % 4 = 3 AND p_partkey % 5 = 0""",
    "name_tricks": """WITH k AS (SELECT 'vis-ual-lib-' || chr(n_nationkey + 97) || 'q' AS known FROM nation)
        SELECT replace(known, '-', '') AS name, known, 'hyphen-omission' AS method FROM k
        UNION ALL SELECT replace(known, 'i', 'iii'), known, 'character-repetition' FROM k
        UNION ALL SELECT known || '-helper', known, 'prefix-suffix' FROM k UNION ALL SELECT 'get-' || known, known, 'prefix-suffix' FROM k
        UNION ALL SELECT '@evil/' || known, known, 'scope-confusion' FROM k
        UNION ALL SELECT replace(known, 'a', 'а'), NULL, 'homoglyph' FROM k WHERE contains(known, 'a')""",
}
