"""Modules of bundles. A bundle holds the whole texts of twenty documents, each as the body of a module."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.operators import bundles
from stratalog.plans.tables import table

#: Documents of a bundle.
TOGETHER = 20


def _bundles(spark, sf_dir):
    """Bundles of modules in all forms: the form says how a body is registered; one form is no factory, one has a long name."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    form, key, text = F.col("doc_id") % 7, F.col("doc_id").cast("string"), F.col("text")
    entry = (
        F.when(form == 0, F.concat(F.lit(","), key, F.lit(":function(e,t){"), text, F.lit("}")))
        .when(form == 1, F.concat(F.lit(","), key, F.lit(":(e,t,n)=>{"), text, F.lit("}")))
        .when(form == 2, F.concat(F.lit(","), key, F.lit(":e=>{"), text, F.lit("}")))
        .when(form == 3, F.concat(F.lit(","), key, F.lit(':"'), text, F.lit('"')))
        .when(form == 4, F.concat(F.lit(';__d("WAWebDoc'), key, F.lit('",function(){'), text, F.lit("});")))
        .when(form == 5, F.concat(F.lit(';__d("'), F.repeat(F.lit("x"), F.lit(257)), F.lit('",function(){'), text, F.lit("});")))
        .otherwise(F.concat(F.lit("{"), key, F.lit(":(a,b,c,d,e,f,g,h,i,j,k,l,m,n,o,p,q,r,s,t,u,v,w,x,y,z,aa,bb,cc)=>{"), text, F.lit("}")))
    )
    made = docs.select(F.floor(F.col("doc_id") / TOGETHER).alias("b"), F.struct("doc_id", entry.alias("entry")).alias("e"))
    whole = made.groupBy("b").agg(F.sort_array(F.collect_list("e")).alias("es"))  # of TOGETHER at most
    return whole.select(F.col("b").cast("string").alias("bundle"), F.lit("app").alias("app"), F.array_join("es.entry", "").alias("body"))


def bundle_split(spark, sf_dir):
    """Every module of every bundle, with offset and size in bytes."""
    found = bundles.split_bundles(_bundles(spark, sf_dir), "bundle", "app", "body")
    return found.withColumn("prefix", bundles.name_prefix(F.col("name")))


def bundle_bodies(spark, sf_dir):
    """The head of each module's body, by joining the modules back to their bundles, through SQL."""
    rows = _bundles(spark, sf_dir)
    bundles.register(spark)
    found = spark.sql("SELECT * FROM split_bundle(TABLE({rows}))", rows=rows)
    body = bundles.module_body(F.encode("body", "UTF-8"), F.col("offset"), F.col("size"), 200)
    return found.join(rows.select("bundle", "body"), "bundle").select("bundle", "kind", "name", "offset", F.md5(body).alias("head_md5"))


QUERIES = {f.__name__: f for f in (bundle_split, bundle_bodies)}

# Offsets are counted on a text of one character a byte: characters beyond ASCII become as many question marks as they have bytes.
_SQL = r"""e AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN ',' || doc_id || ':function(e,t){' || t || '}' WHEN 1 THEN ',' || doc_id || ':(e,t,n)=>{' || t || '}'
              WHEN 2 THEN ',' || doc_id || ':e=>{' || t || '}' WHEN 3 THEN ',' || doc_id || ':"' || t || '"'
              WHEN 4 THEN ';__d("WAWebDoc' || doc_id || '",function(){' || t || '});' WHEN 5 THEN ';__d("' || repeat('x', 257) || '",function(){' || t || '});'
              ELSE '{' || doc_id || ':(a,b,c,d,e,f,g,h,i,j,k,l,m,n,o,p,q,r,s,t,u,v,w,x,y,z,aa,bb,cc)=>{' || t || '}' END AS entry
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        ), b AS (SELECT CAST(doc_id // 20 AS VARCHAR) AS bundle, string_agg(entry, '' ORDER BY doc_id) AS whole FROM e GROUP BY 1
        ), f AS (SELECT bundle, whole, regexp_replace(regexp_replace(regexp_replace(whole, '[^\x00-\x{{FFFF}}]', '????', 'g'), '[^\x00-\x{{7FF}}]', '???', 'g'), '[^\x00-\x7F]', '??', 'g') AS flat FROM b
        ), n AS (SELECT bundle, whole, flat, unnest(regexp_extract_all(flat, '[{{,][0-9]+:')) AS m, unnest(regexp_split_to_array(flat, '[{{,][0-9]+:')[1:-2]) AS gap,
                   generate_subscripts(regexp_extract_all(flat, '[{{,][0-9]+:'), 1) AS i FROM f
        ), o AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY bundle ORDER BY i) AS BIGINT) AS beg FROM n
        ), p AS (SELECT *, coalesce(lead(beg - length(m)) OVER (PARTITION BY bundle ORDER BY i), length(flat)) AS following, substr(flat, beg + 1, 70) AS head FROM o
        ), numbered AS (SELECT bundle, whole, 'numbered' AS kind, 'app_module_' || substr(m, 2, length(m) - 2) AS name, beg, least(following - beg + 1, 1048576) AS size FROM p
            WHERE regexp_matches(head, '^function(?s:.)') OR regexp_matches(head, '^(?s:\(.{{0,60}}\)=>)') OR (regexp_matches(head, '^(?s:[a-z].{{0,29}}=>)') AND length(head) > 3)
        ), c AS (SELECT bundle, whole, flat, unnest(string_split(flat, '__d("')) AS part, generate_subscripts(string_split(flat, '__d("'), 1) AS i FROM f
        ), d AS (SELECT *, CAST(sum(length(part) + 5) OVER (PARTITION BY bundle ORDER BY i) - length(part) - 5 AS BIGINT) AS beg FROM c
        ), named AS (SELECT bundle, whole, 'named' AS kind, regexp_extract(part, '^([^"]*)"', 1) AS name, beg, least(length(part), 1048576) AS size FROM d
            WHERE i > 1 AND regexp_matches(part, '^[^"]{{0,256}}"')
        ), mods AS (SELECT * FROM numbered UNION ALL SELECT * FROM named)""".replace("{{", "{").replace("}}", "}")

ORACLE_SQL = {
    "bundle_split": f"WITH {_SQL} SELECT bundle, kind, name, beg AS offset, size, regexp_extract(name, '^(WAWeb(?:.[^A-Z]*)?)', 1) AS prefix FROM mods",
    "bundle_bodies": f"WITH {_SQL} SELECT bundle, kind, name, beg AS offset, md5(encode(whole)[beg + 1 : beg + least(size, 200)]) AS head_md5 FROM mods",
}
