"""Queries on script bodies, bundles, policies and snapshots' regressions; bodies stand on parts, in all shapes there are."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.functions import shapes as P
from stratalog.functions import text as X
from stratalog.operators import changes, graph, keys, regressions, texts
from stratalog.plans.tables import table

def _key():
    return F.col("p_partkey").cast("string")


def _chosen(which, bodies):
    """The body of number ``which``."""
    return F.element_at(F.array(*bodies), (which + 1).cast("int"))


def _bodies(spark, sf_dir):
    """(id, name, body): twelve shapes in turn."""
    icon = lambda n: F.concat(F.lit('function Icon(){return e.createElement("svg",{viewBox:"0 0 1 1"},'), F.repeat(F.lit('e.createElement("path",{d:"M0 0"}),'), F.lit(n)), F.lit("null)}"))
    runs = F.repeat(F.lit("run();\n"), F.lit(60))
    shapes = [
        F.concat(F.lit('"use strict";\n'), F.repeat(F.concat(F.lit('n.d(t, "N'), _key(), F.lit('", function(){return o}),\n')), F.lit(9))),
        F.concat(F.lit('"use strict";\nObject.defineProperty(exports,"__esModule",{value:!0});'), F.repeat(F.lit('Object.defineProperty(exports,"a",{get: function(){return b.c}});'), F.lit(5))),
        icon(6),
        icon(80),
        F.concat(F.lit('{"kind":"FragmentDefinition","name":"'), F.repeat(F.lit("x"), F.lit(250)), F.lit('"}')),
        F.concat(F.lit("(function (global, factory) {\n"), runs),
        F.concat(F.lit('import x from "@scope/pkg";\n'), runs),
        F.concat(F.lit('{"scopeName":"s","patterns":[]}\n'), runs),
        F.lit("class Widget extends Base {}"),
        F.concat(F.lit("class Panel extends Base {"), runs),
        F.concat(F.lit("class Panel extends Base {"), runs),
        F.repeat(F.lit("é"), F.lit(130)),
    ]
    which = F.col("p_partkey") % 12
    name = F.when(which == 10, F.concat(F.lit("React-DOM."), _key())).when(which == 9, F.concat(F.lit("reactor"), _key())).otherwise(F.concat(F.lit("m"), _key()))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), _chosen(which, shapes).alias("body"))


def body_shapes(spark, sf_dir):
    body = F.col("body")
    found = {"reexport": P.is_reexport(body), "lazy_binding": P.is_lazy_binding(body), "icon": P.is_icon(body), "fragment": P.is_fragment(body)}
    return _bodies(spark, sf_dir).select("id", *[v.alias(k) for k, v in found.items()], texts.is_vendored(body).alias("vendored"), texts.is_vendored_name(F.col("name")).alias("vendored_name"))


def triage_shapes(spark, sf_dir):
    return _bodies(spark, sf_dir).select("id", texts.triage(F.col("body"), F.col("name")).alias("class"))


def promoted_names(spark, sf_dir):
    """Names that bodies give away, by every step of the ladder."""
    put = lambda before, after: F.concat(F.lit(before), _key(), F.lit(after))
    bodies = [
        put('x("src/app/Foo', '.tsx")'), put('log(["[Tag', '] hi"])'), put('require("WAWebFoo', '")'), put("TS.CHANNEL_", ".x"),
        put('__webpack_require__.d(t,"Exp', '",function(){})'), put("n.d(t,{Bar", ":()=>x})"), put('Object.defineProperty(t,"Prop', '",{})'),
        put("exports.Send", " = 1"), put("MicrosoftTeams.Feat", ".do()"), put("class Panel", " extends B{}"), put("function Main", "(){}"),
        F.lit("var x=1"), put('class Late{} y("src/a/Early', '.js")'),
    ]
    return table(spark, sf_dir, "part").select("p_partkey", P.promoted_name(_chosen(F.col("p_partkey") % 13, bodies)).alias("name"))


def synthetic_names(spark, sf_dir):
    put = lambda before, after: F.concat(F.lit(before), _key(), F.lit(after))
    bodies = [put('__d("Mod', '",[])'), put("export default class Page", " {"), put("; function run", "(){"), put('go("route/home', '")'), F.lit("x=1"), F.lit('define("ab",[])')]
    return table(spark, sf_dir, "part").select("p_partkey", P.synthetic_name(_chosen(F.col("p_partkey") % 6, bodies)).alias("name"))


def bundle_modules(spark, sf_dir):
    """Modules of bundles, of which there is one a part brand, with offsets and sizes."""
    call = F.concat(F.lit('__d("C'), "p_partkey", F.lit('",function(){'), "p_type", F.lit("});"))
    bundles = table(spark, sf_dir, "part").groupBy("p_brand", (F.col("p_partkey") % 50).alias("bundle")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", call.alias("call")))).alias("calls"))
    text = F.concat(F.lit("var a;"), F.array_join(F.transform("calls", lambda c: c.call), ""))
    return P.modules_by_name(bundles.select("p_brand", "bundle", text.alias("body")), ["p_brand", "bundle"], "body")


def bundle_ids(spark, sf_dir):
    """Module ids of bundles that map numbers to functions; entries that aren't functions are none."""
    key = F.col("p_partkey")
    entry = F.concat(key, F.when(key % 4 == 0, ":function(e,t){}").when(key % 4 == 1, ":(e,t)=>{x}").when(key % 4 == 2, ":e=>{y}").otherwise(":42"))
    bundles = table(spark, sf_dir, "part").groupBy("p_brand", (key % 50).alias("bundle")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", entry.alias("e")))).alias("es"))
    text = F.concat(F.lit("{"), F.array_join(F.transform("es", lambda x: x.e), ","), F.lit("}"))
    return bundles.select("p_brand", "bundle", F.explode(P.module_ids(text)).alias("module"))


def csp_tokens(spark, sf_dir):
    """Tokens of the policies of parts, with their places."""
    policy = F.concat(F.lit("default-src 'self'; script-src "), F.when(F.col("p_partkey") % 3 == 0, "'unsafe-inline', https://x").otherwise(F.concat(F.lit("https://h"), _key())), F.lit(" ;; img-src *"))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(P.csp_tokens(policy)).alias("place", "token"))


_RULES = regressions.merge_rules(
    [
        regressions.Rule(name, "high")
        for name in (
            "csp-unsafe-inline-added", "csp-unsafe-eval-added", "dangerous-permission-added", "sandbox-flag-removed",
            "contextisolation-disabled", "nodeintegration-enabled", "telemetry-sdk-added", "external-api-endpoint-added", "cert-pinning-removed",
        )
    ],
    [
        regressions.Rule("sandbox-flag-removed", "low", source="user"),
        regressions.Rule("own-http", "medium", "security_config", "added_value_contains", "http:", "user"),
        regressions.Rule("own-lists", "low", "structural", "array_length_increased", source="user"),
    ],
)


def regression_rules(spark, sf_dir):
    """Rules that fire on the changes that orders stand for, with their severity and number of pieces of evidence."""
    k = F.col("o_orderkey")
    strings = lambda *x: F.array(*[F.lit(s) for s in x]).cast("array<string>")
    permission = F.struct(F.lit("CAMERA").alias("name"), (k % 2 == 0).alias("dangerous"))
    pref = lambda old, new: F.struct(F.lit(old).alias("old"), F.lit(new).alias("new"))
    prefs = F.when(k % 5 == 0, F.create_map(F.lit("sandbox"), pref("true", "false"), F.lit("nodeIntegration"), pref("false", "false")))
    prefs = prefs.when(k % 5 == 1, F.create_map(F.lit("contextIsolation"), pref("true", "false"), F.lit("nodeIntegration"), pref("false", "true")))
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(k % 4 == 0, strings("'unsafe-inline'", "http://a")).when(k % 4 == 1, strings("x 'unsafe-eval'")).alias("csp_added"),
        F.when(k % 3 == 0, F.array(permission)).alias("permissions_added"),
        prefs.alias("prefs_changed"),
        (k % 6).alias("telemetry_old"), F.lit(3).alias("telemetry_new"), F.when(k % 6 == 2, strings("a", "b")).alias("telemetry_added"),
        F.lit(1).alias("endpoints_old"), (k % 7).alias("endpoints_new"), strings("/v1").alias("endpoints_added"),
        F.when(k % 11 < 2, k % 11 == 0).alias("cert_pinning_removed"),
    )
    fired = regressions.classify(rows, "o_orderkey", _RULES)
    return fired.select("o_orderkey", "rule", "severity", "source", F.array_join("evidence", "|").alias("evidence"))


def overlap_removed(spark, sf_dir):
    """Windows of eight lines without what they share with the window before."""
    rows = texts.code_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 8, 2)
    before = rows.select("doc_id", (F.col("chunk") + 1).alias("chunk"), F.col("text").alias("before"))
    both = rows.join(before, ["doc_id", "chunk"])
    left = P.without_overlap(F.col("before"), F.col("text"))
    return both.select("doc_id", "chunk", F.length(left).alias("chars"))


def platform_counts(spark, sf_dir):
    """Platforms and languages by the extensions of files that parts are named after."""
    ext = F.element_at(F.array(*[F.lit(x) for x in (".EXE", ".apk", ".tsx", ".tar.gz", ".Wasm", "", ".java", ".d/x")]), (F.col("p_partkey") % 8 + 1).cast("int"))
    name = F.concat(F.lit("dir.v1/file"), _key(), ext)
    rows = table(spark, sf_dir, "part").select(P.by_extension(name, P.PLATFORMS, "other").alias("platform"), P.by_extension(name, P.LANGUAGES, "").alias("language"))
    return rows.groupBy("platform", "language").agg(F.count("*").alias("n"))


def language_symbols(spark, sf_dir):
    """Functions, classes and imports of scripts, each once."""
    body = F.concat(
        F.lit('import a from "m'), _key(), F.lit('";\nimport "side";\nexport async function run'), _key(), F.lit("(x) {}\nfunction run"), _key(),
        F.lit("<T>() {}\nexport abstract class K"), _key(), F.lit(" {}\ninterface I {}\n  class Inner {}\nconst v = require('req');"),
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", body.alias("body"))
    kinds = ("functions", "classes", "consts", "imports")
    return rows.select("p_partkey", *[F.array_join(P.symbols(F.col("body"), "typescript", k), ",").alias(k) for k in kinds])


def dense_literals(spark, sf_dir):
    """Quoted literals of high entropy: the digest of each part in base 64 beside the same characters repeated."""
    dense = F.translate(F.base64(F.concat(F.unhex(F.sha2(_key(), 256)), F.unhex(F.sha2(F.concat(_key(), F.lit("x")), 256)))), "\r\n", "")
    body = F.concat(F.lit('a="'), dense, F.lit('";b="'), F.repeat(F.lit("ab"), F.lit(60)), F.lit("\";c='short'"))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(P.dense_literals(body)).alias("n"), F.length(F.get(P.dense_literals(body), F.lit(0))).alias("chars"))


def name_entropy(spark, sf_dir):
    """Mean entropy of the names of each brand's parts, and whether it is below three bits."""
    mean = F.avg(P.entropy(F.col("p_name")))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(mean, 6).alias("entropy"), (mean < 3.0).alias("low"))


def import_graph(spark, sf_dir):
    """Edges between files that include each other by name; names that no file has are left open."""
    nation = table(spark, sf_dir, "nation")
    body = F.concat(F.lit('#include "r'), "n_regionkey", F.lit('.h"\n#include <stdio.h>\n#include "n'), (F.col("n_nationkey") + 1).cast("string"), F.lit('.h"\n'))
    files = nation.select(F.concat(F.lit("n"), "n_nationkey", F.lit(".h")).alias("file"), body.alias("body"))
    files = files.unionByName(table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey", F.lit(".h")).alias("file"), F.lit("").alias("body")))
    return graph.include_edges(files, "file", "body").select("src", "name", "dst")


def override_wins(spark, sf_dir):
    """Regions of nations with overrides for every third one, and new names that only the overrides have."""
    base = table(spark, sf_dir, "nation").select("n_name", F.col("n_regionkey").alias("region"))
    own = table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select("n_name", (F.col("n_regionkey") + 10).alias("region"))
    own = own.unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("n_name"), F.lit(99).alias("region")))
    return keys.merge_preferring(own, base, ["n_name"])


def source_files_merged(spark, sf_dir):
    """Files by path from two sweeps; those of the first one win."""
    files = lambda parity, sweep: table(spark, sf_dir, "pages").where(F.col("page_id") % 3 != parity).groupBy(X.url_path(F.col("url")).alias("path")).agg(F.min("page_id").alias("page_id")).withColumn("sweep", F.lit(sweep))
    return keys.merge_preferring(files(0, "beautified"), files(1, "swept"), ["path"])


def frameworks_union(spark, sf_dir):
    """Flags of each order's lines in two lists, joined without repeats, in order, empty ones dropped."""
    flag = F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("l_returnflag"))
    lists = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", c.alias("x")))), lambda s: s.x)
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lists(flag).alias("a"), lists(F.col("l_linestatus")).alias("b"))
    joined = F.array_distinct(F.filter(F.concat("a", "b"), lambda x: x != ""))
    return rows.select("l_orderkey", F.array_join(joined, ",").alias("flags"))


def tree_diff(spark, sf_dir):
    """Paths of pages that came, went or changed their kind between even and odd pages."""
    path = F.regexp_extract(X.url_path(F.col("url")), "^(/[^/]*)", 1)
    tag = F.when(F.col("url").endswith(".html"), "html").when(F.col("url").endswith("/"), "folder").otherwise("other")
    rows = table(spark, sf_dir, "pages").select(F.concat_ws("", X.url_host(F.col("url")), path).alias("path"), tag.alias("tag"), (F.col("page_id") % 2).alias("side"))
    side = lambda n: rows.where(F.col("side") == n).groupBy("path").agg(F.max("tag").alias("tag"))
    return changes.tree_diff(side(0), side(1), ["path"], "tag").select("path", "change_type")


def layout_diff(spark, sf_dir):
    """Elements that moved or changed their size from an order's first line to its second."""
    box = {"x": F.col("l_quantity"), "y": F.col("l_tax") * 50, "w": F.floor(F.col("l_extendedprice") / 100).cast("double"), "h": F.floor(F.col("l_discount") * 100).cast("double")}
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.max(v).alias(k) for k, v in box.items()])
    side = lambda n: rows.where(F.col("l_linenumber") == n).drop("l_linenumber")
    return changes.layout_diff(side(1), side(2), ["l_orderkey"]).select("l_orderkey", F.round("dx", 6).alias("dx"), F.round("dw", 6).alias("dw"), "moved", "resized")


QUERIES = {
    f.__name__: f
    for f in (
        body_shapes, triage_shapes, promoted_names, synthetic_names, bundle_modules, bundle_ids, csp_tokens, regression_rules,
        overlap_removed, platform_counts, language_symbols, dense_literals, name_entropy, import_graph, override_wins,
        source_files_merged, frameworks_union, tree_diff, layout_diff,
    )
}

_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"
_PATH = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_W = "CAST(p_partkey % 12 AS INTEGER)"

ORACLE_SQL = {
    "body_shapes": f"""SELECT p_partkey AS id, {_W} = 0 AS reexport, {_W} = 1 AS lazy_binding, {_W} = 2 AS icon, {_W} = 4 AS fragment,
               {_W} IN (5, 6, 7) AS vendored, {_W} = 10 AS vendored_name FROM part""",
    "triage_shapes": f"""SELECT p_partkey AS id, CASE WHEN {_W} IN (0, 5, 6, 7, 8, 10) THEN 'SKIP' WHEN {_W} IN (1, 2, 4) THEN 'STATIC_OK' ELSE 'ENRICH' END AS class FROM part""",
    "promoted_names": """SELECT p_partkey, ['Foo' || p_partkey, 'Tag' || p_partkey, 'WAWebFoo' || p_partkey, 'CHANNEL_' || p_partkey, 'Exp' || p_partkey, 'Bar' || p_partkey,
               'Prop' || p_partkey, 'Send' || p_partkey, 'Feat' || p_partkey, 'Panel' || p_partkey, 'Main' || p_partkey, NULL, 'Early' || p_partkey][p_partkey % 13 + 1] AS name FROM part""",
    "synthetic_names": """SELECT p_partkey, ['Mod' || p_partkey, 'Page' || p_partkey, 'run' || p_partkey, 'route/home' || p_partkey, NULL, NULL][p_partkey % 6 + 1] AS name FROM part""",
    "bundle_modules": """WITH c AS (SELECT p_brand, p_partkey % 50 AS bundle, p_partkey, length('__d("C' || p_partkey || '",function(){' || p_type || '});') AS n FROM part)
        SELECT p_brand, bundle, 'C' || p_partkey AS name, CAST(6 + 5 + sum(n) OVER (PARTITION BY p_brand, bundle ORDER BY p_partkey) - n AS INTEGER) AS offset, CAST(n - 5 AS INTEGER) AS size FROM c""",
    "bundle_ids": "SELECT p_brand, p_partkey % 50 AS bundle, CAST(p_partkey AS VARCHAR) AS module FROM part WHERE p_partkey % 4 <> 3",
    "csp_tokens": """WITH t AS (SELECT p_partkey, unnest(['default-src', '''self''', 'script-src']) AS token, unnest([0, 1, 2]) AS place FROM part
            UNION ALL SELECT p_partkey, unnest(['''unsafe-inline''', 'https://x', 'img-src', '*']), unnest([3, 4, 5, 6]) FROM part WHERE p_partkey % 3 = 0
            UNION ALL SELECT p_partkey, unnest(['https://h' || p_partkey, 'img-src', '*']), unnest([3, 4, 5]) FROM part WHERE p_partkey % 3 <> 0)
        SELECT p_partkey, CAST(place AS INTEGER) AS place, token FROM t""",
    "regression_rules": """WITH o AS (SELECT o_orderkey, o_orderkey AS k FROM orders)
        SELECT o_orderkey, 'csp-unsafe-inline-added' AS rule, 'high' AS severity, 'hardcoded' AS source, '''unsafe-inline''' AS evidence FROM o WHERE k % 4 = 0
        UNION ALL SELECT o_orderkey, 'own-http', 'medium', 'user', 'http://a' FROM o WHERE k % 4 = 0
        UNION ALL SELECT o_orderkey, 'csp-unsafe-eval-added', 'high', 'hardcoded', 'x ''unsafe-eval''' FROM o WHERE k % 4 = 1
        UNION ALL SELECT o_orderkey, 'dangerous-permission-added', 'high', 'hardcoded', 'CAMERA' FROM o WHERE k % 6 = 0
        UNION ALL SELECT o_orderkey, 'sandbox-flag-removed', 'low', 'user', 'sandbox: true -> false' FROM o WHERE k % 5 = 0
        UNION ALL SELECT o_orderkey, 'contextisolation-disabled', 'high', 'hardcoded', 'contextIsolation: true -> false' FROM o WHERE k % 5 = 1
        UNION ALL SELECT o_orderkey, 'nodeintegration-enabled', 'high', 'hardcoded', 'nodeIntegration: false -> true' FROM o WHERE k % 5 = 1
        UNION ALL SELECT o_orderkey, 'telemetry-sdk-added', 'high', 'hardcoded', CASE WHEN k % 6 = 2 THEN 'a|b' ELSE '' END FROM o WHERE k % 6 < 3
        UNION ALL SELECT o_orderkey, 'external-api-endpoint-added', 'high', 'hardcoded', '/v1' FROM o WHERE k % 7 > 1
        UNION ALL SELECT o_orderkey, 'own-lists', 'low', 'user', '' FROM o WHERE k % 6 < 3 OR k % 7 > 1
        UNION ALL SELECT o_orderkey, 'cert-pinning-removed', 'high', 'hardcoded', '' FROM o WHERE k % 11 = 0""",
    "overlap_removed": """WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), c AS (
            SELECT doc_id, l, unnest(range(0, greatest(0, len(l) - 3) + 1, 6)) AS start FROM s
        ), w AS (SELECT doc_id, start // 6 AS chunk, l[start + 1 : start + 8] AS x, list_transform(l[start + 1 : start + 8], lambda y: trim(y, chr(32) || chr(9) || chr(13))) AS t FROM c
        ), p AS (SELECT a.doc_id, a.chunk, a.x, list_max(list_filter(range(1, 9), lambda n: n <= len(a.t) AND n <= len(b.t) AND b.t[len(b.t) - n + 1 : len(b.t)] = a.t[1 : n]
                   AND len(list_filter(a.t[1 : n], lambda y: y = '')) = 0)) AS n FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.chunk = b.chunk + 1)
        SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(length(array_to_string(x[coalesce(n, 0) + 1 : len(x)], chr(10))) AS INTEGER) AS chars FROM p""",
    "platform_counts": """WITH p AS (SELECT CAST(p_partkey % 8 AS INTEGER) AS w FROM part)
        SELECT CASE w WHEN 0 THEN 'windows-pe' WHEN 1 THEN 'android' WHEN 4 THEN 'web' ELSE 'other' END AS platform,
               CASE w WHEN 2 THEN 'typescript' WHEN 6 THEN 'java' ELSE '' END AS language, count(*) AS n FROM p GROUP BY 1, 2""",
    "language_symbols": """SELECT p_partkey, 'run' || p_partkey AS functions, 'K' || p_partkey || ',I' AS classes, 'v' AS consts, 'm' || p_partkey || ',side,req' AS imports FROM part""",
    "dense_literals": """WITH h AS (SELECT p_partkey, to_base64(unhex(sha256(CAST(p_partkey AS VARCHAR)) || sha256(p_partkey || 'x'))) AS d FROM part
        ), c AS (SELECT p_partkey, length(d) AS n, unnest(string_split(d, '')) AS ch FROM h), k AS (SELECT p_partkey, n, ch, count(*) AS k FROM c GROUP BY ALL
        ), e AS (SELECT p_partkey, n, -sum(k / n * log2(k / n)) AS bits FROM k GROUP BY ALL)
        SELECT p_partkey, CASE WHEN bits > 5.0 THEN 1 ELSE 0 END AS n, CASE WHEN bits > 5.0 THEN CAST(n AS INTEGER) END AS chars FROM e""",
    "name_entropy": """WITH c AS (SELECT p_partkey, p_brand, length(p_name) AS n, unnest(string_split(p_name, '')) AS ch FROM part), k AS (
            SELECT p_partkey, p_brand, n, ch, count(*) AS k FROM c GROUP BY ALL), e AS (SELECT p_partkey, p_brand, -sum(k / n * log2(k / n)) AS bits FROM k GROUP BY ALL)
        SELECT p_brand, round(avg(bits), 6) AS entropy, avg(bits) < 3.0 AS low FROM e GROUP BY 1""",
    "import_graph": """SELECT 'n' || n_nationkey || '.h' AS src, 'r' || n_regionkey || '.h' AS name, 'r' || n_regionkey || '.h' AS dst FROM nation
        UNION ALL SELECT 'n' || n.n_nationkey || '.h', 'n' || (n.n_nationkey + 1) || '.h', 'n' || m.n_nationkey || '.h' FROM nation n LEFT JOIN nation m ON m.n_nationkey = n.n_nationkey + 1""",
    "override_wins": """SELECT n_name, n_regionkey + CASE WHEN n_nationkey % 3 = 0 THEN 10 ELSE 0 END AS region FROM nation
        UNION ALL SELECT r_name, 99 FROM region""",
    "source_files_merged": f"""WITH f AS (SELECT {_PATH} AS path, page_id FROM pages), a AS (SELECT path, min(page_id) AS page_id FROM f WHERE page_id % 3 <> 0 GROUP BY 1
        ), b AS (SELECT path, min(page_id) AS page_id FROM f WHERE page_id % 3 <> 1 GROUP BY 1)
        SELECT coalesce(a.path, b.path) AS path, coalesce(a.page_id, b.page_id) AS page_id, CASE WHEN a.path IS NULL THEN 'swept' ELSE 'beautified' END AS sweep
        FROM a FULL OUTER JOIN b ON a.path = b.path""",
    "frameworks_union": """WITH x AS (SELECT l_orderkey, 0 AS side, row_number() OVER w AS i, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_returnflag END AS f FROM lineitem
                   WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)
            UNION ALL SELECT l_orderkey, 1, row_number() OVER w, l_linestatus FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)
        ), d AS (SELECT l_orderkey, f, min(side * 1000000 + i) AS pos FROM x WHERE f <> '' GROUP BY 1, 2)
        SELECT l_orderkey, string_agg(f, ',' ORDER BY pos) AS flags FROM d GROUP BY 1""",
    "tree_diff": f"""WITH p AS (SELECT {_HOST} || regexp_extract({_PATH}, '^(/[^/]*)', 1) AS path, page_id % 2 AS side,
                   CASE WHEN suffix(url, '.html') THEN 'html' WHEN suffix(url, '/') THEN 'folder' ELSE 'other' END AS tag FROM pages
        ), t AS (SELECT path, max(tag) FILTER (WHERE side = 0) AS o, max(tag) FILTER (WHERE side = 1) AS n FROM p GROUP BY 1)
        SELECT path, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' ELSE 'moved' END AS change_type FROM t WHERE o IS DISTINCT FROM n""",
    "layout_diff": """WITH b AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS x, max(l_tax * 50) AS y, max(floor(l_extendedprice / 100)) AS w, max(floor(l_discount * 100)) AS h FROM lineitem GROUP BY 1, 2
        ), d AS (SELECT o.l_orderkey, n.x - o.x AS dx, n.y - o.y AS dy, n.w - o.w AS dw, n.h - o.h AS dh, o.w, o.h FROM b o JOIN b n ON o.l_orderkey = n.l_orderkey AND o.l_linenumber = 1 AND n.l_linenumber = 2
        ), f AS (SELECT *, abs(dx) >= 4 OR abs(dy) >= 4 AS moved, CASE WHEN w > 0 THEN abs(dw) / w ELSE 0 END > 0.1 OR CASE WHEN h > 0 THEN abs(dh) / h ELSE 0 END > 0.1 AS resized FROM d)
        SELECT l_orderkey, round(dx, 6) AS dx, round(dw, 6) AS dw, moved, resized FROM f WHERE moved OR resized""",
}
