"""Queries on texts, names, URLs, versions and small graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.functions import score as S
from stratalog.functions import text as X
from stratalog.functions.canonical import canonical_hash
from stratalog.operators import changes, graph, keys, matching, search, texts
from stratalog.plans.tables import MODULES_SQL, modules, table


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")


def search_ilike_ranked(spark, sf_dir):
    """Parts that contain a word, by weighted similarity."""
    hits = search.search(_parts(spark, sf_dir), "ring", "p_partkey", "p_name", "p_type", ["p_name", "p_type", "p_brand"], 20)
    return hits.select("p_partkey", F.round("relevance", 9).alias("relevance"))


_FIRST = (1.0, 40, 0)


def search_trigram_page(spark, sf_dir):
    """The page of similar parts that follows a cursor."""
    page = search.similar_page(_parts(spark, sf_dir), "red ring", "p_name", "p_size", "p_partkey", 15, after=_FIRST, least=0.2)
    return page.select("p_partkey", "p_size", F.round("similarity", 9).alias("similarity"))


def search_fallback(spark, sf_dir):
    """No part is named like this, so types are searched."""
    rows = _parts(spark, sf_dir)
    names = rows.where(X.contains_ci(F.col("p_name"), "zzz_no%such")).select("p_partkey", "p_name").orderBy("p_partkey")
    types = rows.where(X.contains_ci(F.col("p_type"), "e")).select("p_partkey", "p_name").orderBy("p_partkey")
    return search.with_fallback(names, types, "p_partkey", 25)


def search_like_escape(spark, sf_dir):
    """A pattern with wildcards matches literally."""
    return table(spark, sf_dir, "documents").where(X.contains_ci(F.col("text"), "ion%%%")).select("doc_id")


def snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text"), "licensed").alias("snippet"))


def chunk_search(spark, sf_dir):
    """Paragraphs that mention a licence, by document, with the labels of the document."""
    hits = texts.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text").where(X.contains_ci(F.col("text"), "licensed under"))
    return hits.join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "line", "text", "quality")


def _endpoints(spark, sf_dir, parity):
    pages = table(spark, sf_dir, "pages").where(F.col("page_id") % 2 == parity)
    return pages.select(F.concat(X.url_host(F.col("url")), X.url_path(F.col("url"))).alias("endpoint"))


def endpoint_set_diff(spark, sf_dir):
    return changes.set_diff(_endpoints(spark, sf_dir, 0), _endpoints(spark, sf_dir, 1))


def group_by_origin(spark, sf_dir):
    """Pages of each origin, in blocks of ids; no origin is 'unknown'."""
    origin = F.coalesce(F.nullif(F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1), F.lit("")), F.lit("unknown"))
    rows = table(spark, sf_dir, "pages").select(origin.alias("origin"), "page_id")
    return texts.postings(rows, "origin", "page_id", 1000, "pages")


def domain_type_counts(spark, sf_dir):
    """Counts by domain and by kind of path, side by side."""
    path = X.url_path(F.col("url"))
    kind = F.when(path.endswith(".html"), "html").when(path.endswith("/"), "folder").otherwise("other")
    domain = F.regexp_extract(X.url_host(F.col("url")), r"([^.]+\.[^.]+)$", 1)
    rows = table(spark, sf_dir, "pages").select(domain.alias("domain"), kind.alias("kind"))
    return rows.groupingSets([[F.col("domain")], [F.col("kind")]], "domain", "kind").agg(F.count("*").alias("n"))


def endpoint_dedup(spark, sf_dir):
    """The first page of each scheme, host and first two path segments."""
    url = F.col("url")
    key = [
        F.lower(F.regexp_extract(url, "^([a-zA-Z]+)://", 1)).alias("scheme"),
        X.url_host(url).alias("host"),
        F.regexp_extract(X.url_path(url), "^((?:/[^/]*){0,2})", 1).alias("head"),
    ]
    return keys.representatives(table(spark, sf_dir, "pages").select("page_id", *key), ["scheme", "host", "head"], ["page_id"])


def low_signal_urls(spark, sf_dir):
    """Pages but for those with tracking parameters or fragments only."""
    return table(spark, sf_dir, "pages").where(~F.col("url").rlike("utm_|#top$|/[0-9]+\\.html$")).select("page_id", "url")


def host_match(spark, sf_dir):
    """Each page's host against known hosts, exactly or by suffix."""
    pages = table(spark, sf_dir, "pages").select("page_id", X.url_host(F.col("url")).alias("host"))
    known = spark.sql("SELECT * FROM VALUES ('example.com'), ('example.net'), ('tionsh.example.net'), ('org') AS t(known)")
    return matching.host_or_suffix(pages, known, "host", "known").select("page_id", "known", "match")


def inverted_index(spark, sf_dir):
    """Suppliers of every part, in blocks of ids."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return texts.postings(rows, "l_partkey", "l_suppkey", 50, "suppliers")


def version_posture_range_join(spark, sf_dir):
    """Parts whose size lies in a range of a vulnerability of their kind; the end is open."""
    ranges = spark.sql("SELECT * FROM VALUES ('V1', 0, 10), ('V1', 5, 12), ('V2', 20, 31), ('V3', 45, NULL) AS t(vuln_id, introduced, fixed)")
    rows = _parts(spark, sf_dir).select("p_partkey", "p_size", F.lit(1).alias("one"))
    found = matching.in_range(rows, ranges.withColumn("one", F.lit(1)), ["one"], F.col("p_size"), "introduced", "fixed", "vuln_id")
    return found.select("p_partkey", "p_size", "vuln_id")


def outdated_by(spark, sf_dir):
    """How far version p.q.r of each part is behind 3.2.1."""
    version = F.concat_ws(".", F.floor(F.col("p_size") / 10), F.col("p_size") % 10, F.col("p_partkey") % 4)
    delta = S.outdated_by(version, F.lit("v3.2.1"))
    rows = _parts(spark, sf_dir).select("p_partkey", version.alias("declared"), delta.alias("d"))
    return rows.select("p_partkey", "declared", F.col("d.major").alias("major"), F.col("d.minor").alias("minor"), F.col("d.patch").alias("patch"))


def alias_merge(spark, sf_dir):
    """Priorities that each customer's orders have, found by the customer's aliases."""
    spine = table(spark, sf_dir, "customer").select("c_custkey", F.array(F.concat(F.lit("C-"), "c_custkey"), F.concat(F.lit("X-"), "c_custkey")).alias("aliases"))
    other = table(spark, sf_dir, "orders").select(F.concat(F.lit("C-"), "o_custkey").alias("alias"), "o_orderpriority")
    merged = matching.merge_by_alias(spine, other, "c_custkey", "aliases", "o_orderpriority")
    return merged.select("c_custkey", F.array_join("values", ",").alias("priorities"))


def topic_derive(spark, sf_dir):
    """Topics of turns, of which the role of every third is known, counted."""
    role = F.when(F.col("turn") % 3 == 0, "Pair").when(F.col("turn") % 3 == 1, F.col("role"))
    rows = table(spark, sf_dir, "conversations").select(texts.topic(role, F.col("role"), F.substring("text", 1, 60)).alias("topic"))
    return rows.groupBy("topic").agg(F.count("*").alias("n"))


_RULES = (
    ("licence", "licensed under", 0.9, 1, False), ("licence", "released under", 0.8, 2, False), ("prose", "the", 0.5, 5, False),
    ("prose", "###", 0.5, 5, True), ("french", "eau", 0.6, 3, False), ("spanish", "ción", 0.6, 3, False), ("german", "keit", 0.6, 3, False),
)


def component_rules(spark, sf_dir):
    rules = [texts.ComponentRule(c, conf, prio, keyword=p, suppress=gone) for c, p, conf, prio, gone in _RULES]
    rules.append(texts.ComponentRule("site", 0.95, 1, keyword="released", path="^src1", name="^(en|de)$"))
    rules.append(texts.ComponentRule("listed", 0.8, 2, keyword=("Unter", "sous ", "bajo ")))
    found = texts.with_component(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), rules, F.col("text"), F.col("source"), F.col("lang"))
    return found.select("doc_id", "component", "confidence")


_BUCKETS = (("^https?://(www|blog|m)\\.", "site"), ("/(en|de)/", "germanic"), ("/(fr|es)/", "romance"))


def bucket_classify(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.first_match(F.col("url"), _BUCKETS, "unknown").alias("bucket"))


def vendored_flag(spark, sf_dir):
    rows = modules(spark, sf_dir, labels=False).select("app", texts.is_vendored(F.col("body")).alias("vendored"))
    return rows.groupBy("app").agg(F.count("*").alias("modules"), F.count_if("vendored").alias("vendored"))


def triage(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.triage(F.col("text")).alias("class"))


def symbol_extract(spark, sf_dir):
    """Distinct capitalised words and e-mail addresses, ten of each at most."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.array_join(X.capped_matches(text, "[A-Z][a-z]+", 10), ",").alias("names"),
        F.array_join(X.capped_matches(text, "[a-z0-9.]+@[a-z0-9.]+", 10), ",").alias("addresses"),
    )


def entropy(spark, sf_dir):
    bits = texts.shannon_entropy(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return bits.select("doc_id", F.abs(F.round("entropy", 6)).alias("entropy"))


_PATTERNS = (("secret", "[A-Za-z0-9]{24,}", 40, 3), ("address", "[a-z0-9.]+@[a-z0-9.]+", 10, 2), ("markup", "[#*$%&|<>]{3}", 2, 1))


def threat_score(spark, sf_dir):
    """Findings, score and worst severity by category, total and level per document; each line counts once a pattern."""
    rows = texts.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text")
    finding = F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(c).alias("category"), F.lit(w).alias("weight"), F.lit(r).alias("rank"))) for c, p, w, r in _PATTERNS])
    found = rows.select("doc_id", F.explode(F.filter(finding, lambda x: x.isNotNull())).alias("f"))
    per = found.groupBy("doc_id").agg(
        F.count("*").alias("findings"), F.sum("f.weight").alias("score"), F.max_by("f.category", F.col("f.rank")).alias("worst"), F.countDistinct("f.category").alias("categories")
    )
    return per.withColumn("level", S.threat_level(F.col("score")))


def typosquat(spark, sf_dir):
    """Suppliers whose name is within one edit of the name of one of the first ten."""
    names = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), "s_suppkey")
    popular = names.where("s_suppkey % 10 = 1").select(F.col("name").alias("known"))
    return matching.near_names(names.select("name"), popular, "name", "known", 1).select("name", "distance")


def multiset_jaccard(spark, sf_dir):
    """Similarity of each language's word counts between two sources."""
    words = table(spark, sf_dir, "documents").select("lang", "source", F.explode(F.split("text", " ")).alias("token"))
    side = lambda s: words.where(F.col("source") == s)
    return texts.multiset_similarity(side("src1"), side("src2"), "lang", "token")


def hamming_severity(spark, sf_dir):
    """Distance of the sign bits of each vector from those of the vector before, and its severity; 64 bits in two words."""
    word = lambda k: F.aggregate(F.slice("embedding", 32 * k + 1, 32), F.lit(0).cast("long"), lambda acc, x: acc * 2 + (x > 0).cast("long"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", word(0).alias("a"), word(1).alias("b"))
    before = rows.select((F.col("vec_id") + 1).alias("vec_id"), F.col("a").alias("old_a"), F.col("b").alias("old_b"))
    distance = (F.bit_count(F.col("a").bitwiseXOR(F.col("old_a"))) + F.bit_count(F.col("b").bitwiseXOR(F.col("old_b")))).cast("int")
    both = rows.join(before, "vec_id").select("vec_id", distance.alias("distance"))
    return both.select("vec_id", "distance", S.hamming_severity(F.col("distance"), 24, 32).alias("severity"))


def css_last_wins(spark, sf_dir):
    """The last of equal turns of a conversation."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("chars"))
    return keys.representatives(rows, ["conv_id", "role"], [(-F.col("turn")).alias("turn")])


def registry_materialize(spark, sf_dir):
    """One row for every nation and the categories of its region; region 0 has all."""
    cats = spark.sql("SELECT * FROM VALUES ('auth', array(0, 1)), ('crypto', array(0, 2, 3)), ('ui', NULL) AS t(category, regions)")
    every = table(spark, sf_dir, "region").agg(F.sort_array(F.collect_list("r_regionkey")).alias("every"))
    rows = cats.join(F.broadcast(every)).select("category", F.explode(F.coalesce("regions", "every")).alias("n_regionkey"))
    return table(spark, sf_dir, "nation").join(matching.small(rows), "n_regionkey").select("n_name", "category")


def code_chunks(spark, sf_dir):
    """Windows of eight lines that overlap by two."""
    chunks = texts.code_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 8, 2)
    return chunks.select("doc_id", "chunk", "first_line", F.length("text").alias("chars"))


def hierarchy_depth(spark, sf_dir):
    """Depth of every nation and region below a common root, by a recursive query."""
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit("root").alias("parent"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    root = spark.sql("SELECT 'root' AS child, CAST(NULL AS STRING) AS parent")
    return spark.sql(graph.depth_sql("{edges}", "parent IS NULL"), edges=regions.unionByName(nations).unionByName(root))


def dependency_resolution(spark, sf_dir):
    """Ids of the nations that customers name within the region of their own nation."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("grp"))
    named = table(spark, sf_dir, "customer").join(matching.small(nations.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "grp")), "c_nationkey")
    edges = named.select("c_custkey", "n_name", F.when(F.col("c_custkey") % 7 == 0, F.col("grp") + 1).otherwise(F.col("grp")).alias("grp"))
    return graph.resolve_names(edges, nations, "grp", "n_name", "n_nationkey").select("c_custkey", "to_id")


def canonical_groups(spark, sf_dir):
    """Bodies that are equal in canonical form, with the number of their different texts."""
    rows = table(spark, sf_dir, "documents").select("doc_id", canonical_hash(F.col("text")).alias("hash"), F.xxhash64("text").alias("body"))
    groups = rows.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.countDistinct("body").alias("texts"))
    return groups.where("n > 1").select("first_id", "n", "texts")


def sections(spark, sf_dir):
    """Sections of the Markdown reports that orders stand for: a line of text, a heading, a heading below it for each line."""
    line = F.concat(F.lit("## Line "), "l_linenumber", F.lit("\npart "), "l_partkey", F.lit("\n\nqty "), F.col("l_quantity").cast("int"))
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("t"))))
    reports = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lines.alias("ls"))
    text = F.concat(F.lit("intro\n# Order "), "l_orderkey", F.lit("\n"), F.array_join(F.transform("ls", lambda x: x.t), "\n"))
    found = texts.markdown_sections(reports.select("l_orderkey", text.alias("report")), "l_orderkey", "report")
    return found.select("l_orderkey", "section", "title", "text", "has_code")


def document_sections(spark, sf_dir):
    """Sections of all documents, whose lines are headings and fences here and there."""
    line = F.transform(F.split("text", "\n"), lambda x, i: F.when((F.length(x) + i) % 5 == 0, F.concat(F.repeat(F.lit("#"), F.length(x) % 6), F.lit(" "), x)).when((F.length(x) + i) % 7 == 0, F.concat(F.lit("```"), x)).otherwise(x))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_join(line, "\n").alias("t"))
    found = texts.markdown_sections(rows, "doc_id", "t")
    return found.select("doc_id", "section", "title", F.md5("text").alias("text_md5"), "has_code")


def minified_flag(spark, sf_dir):
    """Documents that look minified: as they are, and with all line ends taken out of every other one."""
    text = F.when(F.col("doc_id") % 2 == 0, F.translate("text", "\n", " ")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", X.looks_minified(text).alias("minified"))


def source_chunks(spark, sf_dir):
    """Documents whole up to 4096 bytes, larger ones in windows of eight lines."""
    chunks = texts.source_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 4096, 8, 2)
    return chunks.select("doc_id", "chunk", "title", F.length("text").alias("chars"))


def summary_lines(spark, sf_dir):
    rows = modules(spark, sf_dir)
    given = F.when(F.col("id") % 4 == 0, F.concat(F.lit("teams_module_"), "id")).otherwise(F.substring("body_sha256", 1, 8))
    name = X.display_name(given, F.when(F.col("id") % 3 == 0, F.lit(" \t")).otherwise(F.concat(F.lit(" module of "), "app", F.lit("\n"))))
    return rows.select("id", X.summary_line(name, F.col("lang"), F.when(F.col("toxic") == 1, "toxic")).alias("line"))


QUERIES = {
    f.__name__: f
    for f in (
        search_ilike_ranked, search_trigram_page, search_fallback, search_like_escape, snippet, chunk_search, endpoint_set_diff,
        group_by_origin, domain_type_counts, endpoint_dedup, low_signal_urls, host_match, inverted_index,
        version_posture_range_join, outdated_by, alias_merge, topic_derive, component_rules, bucket_classify, vendored_flag,
        triage, symbol_extract, entropy, threat_score, typosquat, multiset_jaccard, hamming_severity, css_last_wins,
        registry_materialize, code_chunks, hierarchy_depth, dependency_resolution, summary_lines, canonical_groups, sections, document_sections, source_chunks,
        minified_flag,
    )
}


def _grams(x: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _similar(a: str, b: str) -> str:
    both = f"len(list_intersect({_grams(a)}, {_grams(b)}))"
    return f"({both} / (len({_grams(a)}) + len({_grams(b)}) - {both}))"


_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"
_PATH = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
# The rules once more, written out for SQL.
_VENDORED = r"""vend AS (
            SELECT *, contains(body, 'node_modules/') OR contains(body, '/*!') OR contains(body, '@license') OR contains(body, '"tokenColors"')
                   OR contains(body, 'clerk.com') OR contains(body, 'Clerk: ') OR contains(body, '@clerk/') OR contains(body, 'mermaid')
                   OR contains(stripped, '(function(global,factory)') OR contains(stripped, 'typeofexports==="object"&&typeofmodule!=="undefined"')
                   OR contains(replace(stripped, chr(39), '`'), 'typeofexports===`object`&&typeofmodule!==`undefined`')
                   OR regexp_matches(body, '(?:require\(|from\s+|import\s+)["'']@[a-z0-9][a-z0-9._-]*/[a-z0-9][a-z0-9._/-]*["'']')
                   OR (contains(body, '"scopeName"') AND (contains(body, '"patterns"') OR contains(body, '"repository"'))) AS vendored
            FROM (SELECT doc_id, source AS app, text AS body, regexp_replace(text, '[ \t\n\r\f\v]', '', 'g') AS stripped FROM documents))"""
_TOPIC = " ".join(
    "WHEN contains(low, '{}') THEN '{}'".format(*pair.split(":"))
    for pair in sorted(
        (
            "analytics:telemetry audio:media auth:auth blob:storage cache:storage chat:messaging cipher:crypto component:ui credential:auth "
            "crypto:crypto db:storage decrypt:crypto dom:ui encrypt:crypto image:media indexeddb:storage key:crypto log:telemetry logger:telemetry "
            "login:auth media:media message:messaging metric:telemetry msg:messaging oauth:auth online:presence persist:storage presence:presence "
            "react:ui receive:messaging render:ui ring:call send:messaging sendmessage:messaging session:auth signal:crypto storage:storage "
            "stream:media telemetry:telemetry thumbnail:media token:auth tracking:telemetry typing:presence video:media view:ui voip:call window:ui"
        ).split(),
        key=lambda pair: pair.split(":")[0],
    )
)

ORACLE_SQL = {
    "search_ilike_ranked": f"""WITH h AS (
            SELECT p_partkey, p_name, p_type, p_name || ' ' || p_type || ' ' || p_brand AS everything FROM part
        ), f AS (SELECT * FROM h WHERE everything ILIKE '%ring%')
        SELECT p_partkey, round(2.0 * {_similar('p_name', "'ring'")} + 1.5 * {_similar('p_type', "'ring'")} + {_similar('everything', "'ring'")}, 9) AS relevance
        FROM f ORDER BY relevance DESC, p_partkey LIMIT 20""",
    "search_trigram_page": f"""WITH s AS (SELECT p_partkey, p_size, {_similar('p_name', "'red ring'")} AS similarity FROM part)
        SELECT p_partkey, p_size, round(similarity, 9) AS similarity FROM s WHERE similarity >= 0.2
          AND (similarity < 1.0 OR (similarity = 1.0 AND p_size < 40) OR (similarity = 1.0 AND p_size = 40 AND p_partkey > 0))
        ORDER BY s.similarity DESC, p_size DESC, p_partkey LIMIT 15""",
    "search_fallback": "SELECT p_partkey, p_name, 1 AS branch FROM part WHERE p_type ILIKE '%e%' ORDER BY p_partkey LIMIT 25",
    "search_like_escape": "SELECT doc_id FROM documents WHERE contains(lower(text), 'ion%%%')",
    "snippet": """SELECT doc_id, substr(text, greatest(1, instr(lower(text), 'licensed') - 16), 64) AS snippet FROM documents""",
    "chunk_search": r"""WITH l AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)
        SELECT l.doc_id, CAST(line AS INTEGER) AS line, text, quality FROM l LEFT JOIN labels b ON b.doc_id = l.doc_id WHERE text ILIKE '%licensed under%'""",
    "endpoint_set_diff": f"""WITH e AS (SELECT page_id % 2 AS side, {_HOST} || {_PATH} AS endpoint FROM pages)
        SELECT endpoint, CASE WHEN max(side) = 0 THEN 'removed' ELSE 'added' END AS change FROM e GROUP BY 1 HAVING count(DISTINCT side) = 1""",
    "group_by_origin": """SELECT coalesce(nullif(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), ''), 'unknown') AS origin, page_id // 1000 AS block, count(*) AS n,
               string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) AS pages FROM pages GROUP BY 1, 2""",
    "domain_type_counts": rf"""WITH p AS (
            SELECT regexp_extract({_HOST}, '([^.]+\.[^.]+)$', 1) AS domain,
                   CASE WHEN suffix({_PATH}, '.html') THEN 'html' WHEN suffix({_PATH}, '/') THEN 'folder' ELSE 'other' END AS kind FROM pages)
        SELECT domain, kind, count(*) AS n FROM p GROUP BY GROUPING SETS ((domain), (kind))""",
    "endpoint_dedup": rf"""SELECT min(page_id) AS page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, {_HOST} AS host,
               regexp_extract({_PATH}, '^((?:/[^/]*){{0,2}})', 1) AS head FROM pages GROUP BY 2, 3, 4""",
    "low_signal_urls": r"SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, 'utm_|#top$|/[0-9]+\.html$')",
    "host_match": f"""WITH p AS (SELECT page_id, {_HOST} AS host FROM pages), k AS (
            SELECT unnest(['example.com', 'example.net', 'tionsh.example.net', 'org']) AS known
        ), m AS (SELECT page_id, host, arg_max(known, length(known)) AS known FROM p LEFT JOIN k
                 ON host = known OR suffix(host, '.' || known) GROUP BY 1, 2)
        SELECT page_id, known, CASE WHEN known IS NULL THEN 'none' WHEN known = host THEN 'exact' ELSE 'suffix' END AS match FROM m""",
    "inverted_index": """SELECT l_partkey, l_suppkey // 50 AS block, count(*) AS n, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey) AS suppliers
        FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) GROUP BY 1, 2""",
    "version_posture_range_join": """SELECT DISTINCT p_partkey, p_size, vuln_id FROM part
        JOIN (VALUES ('V1', 0, 10), ('V1', 5, 12), ('V2', 20, 31), ('V3', 45, NULL)) t(vuln_id, introduced, fixed)
          ON p_size >= introduced AND (fixed IS NULL OR p_size < fixed)""",
    "outdated_by": """WITH v AS (SELECT p_partkey, p_size // 10 AS a, p_size % 10 AS b, p_partkey % 4 AS c FROM part
        ), d AS (SELECT p_partkey, a || '.' || b || '.' || c AS declared, greatest(3 - a, 0) AS x, greatest(2 - b, 0) AS y, greatest(1 - c, 0) AS z FROM v)
        SELECT p_partkey, declared, CASE WHEN x + y + z > 0 THEN x END AS major,
               CASE WHEN x + y + z > 0 THEN CASE WHEN x > 0 THEN 0 ELSE y END END AS minor,
               CASE WHEN x + y + z > 0 THEN CASE WHEN x > 0 OR y > 0 THEN 0 ELSE z END END AS patch FROM d""",
    "alias_merge": """SELECT c_custkey, coalesce(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority), '') AS priorities
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
    "topic_derive": f"""SELECT CASE {_TOPIC} WHEN turn % 3 = 0 THEN 'auth' ELSE 'other' END AS topic, count(*) AS n
        FROM (SELECT turn, lower(coalesce(role, '') || ' ' || coalesce(substr(text, 1, 60), '')) AS low FROM conversations) GROUP BY 1""",
    "component_rules": """WITH r AS (SELECT * FROM (VALUES (1, 'licence', 'licensed under', 0.9, 1, false), (2, 'licence', 'released under', 0.8, 2, false), (3, 'prose', 'the', 0.5, 5, false),
            (4, 'prose', '###', 0.5, 5, true), (5, 'french', 'eau', 0.6, 3, false), (6, 'spanish', 'ción', 0.6, 3, false), (7, 'german', 'keit', 0.6, 3, false)) t(i, component, pattern, confidence, priority, suppress)
        ), m AS (SELECT doc_id, i, component, confidence, priority, suppress FROM documents JOIN r ON contains(lower(text), pattern)
            UNION ALL SELECT doc_id, 8, 'site', 0.95, 1, false FROM documents WHERE contains(lower(text), 'released') AND source LIKE 'src1%' AND lang IN ('en', 'de')
            UNION ALL SELECT doc_id, 9, 'listed', 0.8, 2, false FROM documents WHERE contains(lower(text), 'unter') OR contains(lower(text), 'sous ') OR contains(lower(text), 'bajo ')
        ), k AS (SELECT doc_id, component, confidence, priority, row_number() OVER w AS place, lead(component) OVER w AS next, lead(confidence) OVER w AS next_confidence, lead(priority) OVER w AS next_priority
            FROM m WHERE NOT suppress AND (doc_id, component) NOT IN (SELECT (doc_id, component) FROM m WHERE suppress) WINDOW w AS (PARTITION BY doc_id ORDER BY confidence DESC, priority, i)
        ), b AS (SELECT doc_id, component, CAST(confidence AS DOUBLE) AS confidence FROM k WHERE place = 1 AND NOT coalesce(next <> component AND next_confidence = confidence AND next_priority = priority, false))
        SELECT d.doc_id, coalesce(component, 'other') AS component, coalesce(confidence, 1.0) AS confidence FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id""",
    "bucket_classify": """SELECT page_id, CASE {} ELSE 'unknown' END AS bucket FROM pages""".format(
        " ".join(f"WHEN regexp_matches(url, '{p}') THEN '{b}'" for p, b in _BUCKETS)
    ),
    "vendored_flag": f"WITH {_VENDORED} SELECT app, count(*) AS modules, count(*) FILTER (WHERE vendored) AS vendored FROM vend GROUP BY app",
    "triage": f"""WITH {_VENDORED}
        SELECT doc_id, CASE WHEN strlen(body) < 256 OR vendored THEN 'SKIP' ELSE 'ENRICH' END AS class FROM vend""",
    "symbol_extract": """WITH f AS (SELECT doc_id, unnest([1, 2]) AS kind, unnest([regexp_extract_all(text, '[A-Z][a-z]+'), regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9.]+')]) AS l FROM documents
        ), w AS (SELECT doc_id, kind, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM f
        ), d AS (SELECT doc_id, kind, w, min(i) AS i FROM w GROUP BY 1, 2, 3
        ), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY i) AS rn FROM d)
        SELECT o.doc_id, coalesce(string_agg(w, ',' ORDER BY i) FILTER (WHERE kind = 1), '') AS names,
               coalesce(string_agg(w, ',' ORDER BY i) FILTER (WHERE kind = 2), '') AS addresses
        FROM documents o LEFT JOIN t ON t.doc_id = o.doc_id AND rn <= 10 GROUP BY 1""",
    "entropy": """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT doc_id, ch, count(*) AS k FROM c GROUP BY 1, 2
        ), t AS (SELECT doc_id, sum(k) AS total FROM n GROUP BY 1)
        SELECT n.doc_id, abs(round(-sum(k / total * log2(k / total)), 6)) AS entropy FROM n JOIN t ON t.doc_id = n.doc_id GROUP BY 1""",
    "threat_score": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents), p AS (
            SELECT * FROM (VALUES {}) t(category, pattern, weight, rank)
        ), f AS (SELECT doc_id, category, weight, rank FROM l JOIN p ON regexp_matches(text, pattern) WHERE trim(text) <> ''), s AS (
            SELECT doc_id, count(*) AS findings, CAST(sum(weight) AS BIGINT) AS score, arg_max(category, rank) AS worst, count(DISTINCT category) AS categories FROM f GROUP BY 1)
        SELECT *, CASE WHEN score >= 200 THEN 'CRITICAL' WHEN score >= 100 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' WHEN score >= 1 THEN 'LOW' ELSE 'CLEAN' END AS level FROM s""".format(
        ", ".join(str(p) for p in _PATTERNS)
    ),
    "typosquat": """SELECT a.s_name AS name, min(levenshtein(a.s_name, b.s_name)) AS distance FROM supplier a JOIN supplier b
        ON b.s_suppkey % 10 = 1 AND a.s_name <> b.s_name AND levenshtein(a.s_name, b.s_name) <= 1 GROUP BY 1""",
    "multiset_jaccard": """WITH w AS (SELECT lang, source, unnest(string_split(text, ' ')) AS token FROM documents), c AS (
            SELECT lang, token, count(*) FILTER (WHERE source = 'src1') AS a, count(*) FILTER (WHERE source = 'src2') AS b
            FROM w WHERE source IN ('src1', 'src2') GROUP BY 1, 2)
        SELECT lang, sum(least(a, b)) / sum(greatest(a, b)) AS similarity FROM c GROUP BY 1""",
    "hamming_severity": """WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings), d AS (
            SELECT a.vec_id, CAST(len(list_filter(range(1, 65), lambda i: a.bits[i] <> b.bits[i])) AS INTEGER) AS distance FROM b a JOIN b b ON a.vec_id = b.vec_id + 1)
        SELECT *, CASE WHEN distance <= 24 THEN 'PASS' WHEN distance <= 32 THEN 'FLAG' ELSE 'BLOCK' END AS severity FROM d""",
    "css_last_wins": """SELECT DISTINCT ON (conv_id, role) conv_id, turn, role, length(text) AS chars FROM conversations ORDER BY conv_id, role, turn DESC""",
    "registry_materialize": """WITH c AS (SELECT 'auth' AS category, [0, 1] AS regions UNION ALL SELECT 'crypto', [0, 2, 3] UNION ALL SELECT 'ui', NULL), e AS (
            SELECT category, unnest(coalesce(regions, (SELECT list(r_regionkey) FROM region))) AS k FROM c)
        SELECT n_name, category FROM nation JOIN e ON k = n_regionkey""",
    "code_chunks": """WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), c AS (
            SELECT doc_id, l, unnest(range(0, greatest(0, len(l) - 3) + 1, 6)) AS start FROM s)
        SELECT doc_id, CAST(start // 6 AS INTEGER) AS chunk, CAST(start + 1 AS INTEGER) AS first_line,
               CAST(length(array_to_string(l[start + 1 : start + 8], chr(10))) AS INTEGER) AS chars FROM c""",
    "hierarchy_depth": """SELECT 'root' AS node, 0 AS depth UNION ALL SELECT 'r' || r_regionkey, 1 FROM region
        UNION ALL SELECT 'n' || n_nationkey, 2 FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region)""",
    "dependency_resolution": """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN
               (SELECT min(m.n_nationkey) FROM nation m WHERE m.n_name = n.n_name AND m.n_regionkey = n.n_regionkey + 1)
               ELSE (SELECT min(m.n_nationkey) FROM nation m WHERE m.n_name = n.n_name AND m.n_regionkey = n.n_regionkey) END AS to_id
        FROM customer JOIN nation n ON n.n_nationkey = c_nationkey""",
    "sections": """WITH l AS (SELECT l_orderkey, l_linenumber AS n, l_partkey AS p, CAST(l_quantity AS INTEGER) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)) AS i FROM lineitem)
        SELECT l_orderkey, CAST(i + 1 AS INTEGER) AS section, 'Order ' || l_orderkey || ' > Line ' || n AS title, '## Line ' || n || chr(10) || 'part ' || p || chr(10) || chr(10) || 'qty ' || q AS text, false AS has_code FROM l
        UNION ALL SELECT DISTINCT l_orderkey, 1, 'Order ' || l_orderkey, '# Order ' || l_orderkey, false FROM l UNION ALL SELECT DISTINCT l_orderkey, 0, 'Intro', 'intro', false FROM l""",
    "document_sections": r"""WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL
        ), l AS (SELECT doc_id, i, CASE WHEN (length(x) + i) % 5 = 0 THEN repeat('#', length(x) % 6) || ' ' || x WHEN (length(x) + i) % 7 = 0 THEN '```' || x ELSE x END AS line FROM x
        ), h AS (SELECT *, nullif(length(regexp_extract(line, '^(#{1,4})[ \t\f\r]+(.+)$', 1)), 0) AS level, trim(regexp_extract(line, '^(#{1,4})[ \t\f\r]+(.+)$', 2), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM l
        ), s AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM h
        ), heads AS (SELECT doc_id, s, level, t FROM s WHERE level IS NOT NULL
        ), stack AS (SELECT a.doc_id, a.s, string_agg(b.t, ' > ' ORDER BY b.s) AS title FROM heads a JOIN heads b ON b.doc_id = a.doc_id AND b.s <= a.s
            WHERE NOT EXISTS (SELECT 1 FROM heads c WHERE c.doc_id = a.doc_id AND c.s > b.s AND c.s <= a.s AND c.level <= b.level) GROUP BY 1, 2
        ), g AS (SELECT doc_id, s, trim(string_agg(line, chr(10) ORDER BY i), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM s GROUP BY 1, 2)
        SELECT g.doc_id, CAST(row_number() OVER (PARTITION BY g.doc_id ORDER BY g.s) - 1 AS INTEGER) AS section, coalesce(nullif(title, ''), 'Intro') AS title, md5(text) AS text_md5, regexp_matches(text, '(?s)```.*?```') AS has_code
        FROM g LEFT JOIN stack ON stack.doc_id = g.doc_id AND stack.s = g.s WHERE text <> ''""",
    "minified_flag": """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), ' ') ELSE text END AS text FROM documents
        ), h AS (SELECT doc_id, strlen(text) AS n, encode(text)[1:65536] AS head FROM t
        ), f AS (SELECT doc_id, n, string_split(regexp_replace(regexp_replace(hex(head), '(..)', '\\1 ', 'g'), '0A ', chr(10), 'g'), chr(10)) AS ls, octet_length(head) AS seen FROM h)
        SELECT doc_id, coalesce(n >= 512 AND list_max(list_transform(ls, lambda x: length(x) // 3)) >= 2000 AND (len(ls) - 1) / seen < 0.002, false) AS minified FROM f""",
    "source_chunks": """WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE strlen(text) > 4096), c AS (
            SELECT doc_id, l, unnest(range(0, greatest(0, len(l) - 3) + 1, 6)) AS start FROM s)
        SELECT doc_id, CAST(start // 6 AS INTEGER) AS chunk, 'Lines ' || (start + 1) || '-' || least(start + 8, len(l)) AS title,
               CAST(length(array_to_string(l[start + 1 : start + 8], chr(10))) AS INTEGER) AS chars FROM c
        UNION ALL SELECT doc_id, 0, 'Source', CAST(length(text) AS INTEGER) FROM documents WHERE strlen(text) <= 4096""",
    "summary_lines": f"""WITH {MODULES_SQL}
        SELECT id, coalesce(CASE WHEN lang <> '' THEN '[' || lang || '] ' END, '') || CASE WHEN id % 4 = 0 AND id % 3 <> 0 THEN 'module of ' || app WHEN id % 4 = 0 THEN 'teams_module_' || id ELSE substr(body_sha256, 1, 8) END
               || CASE WHEN toxic = 1 THEN ' {{toxic}}' ELSE '' END AS line FROM modules""",
}
