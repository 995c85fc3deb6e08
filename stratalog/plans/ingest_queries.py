"""Queries on ingestion and upkeep of the catalogue, on scores that add up several signals, and on times and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stratalog.functions import score as S
from stratalog.functions import times as T
from stratalog.operators import changes, events, keys
from stratalog.plans.tables import modules, snapshots, table, usage

NOW = dt.datetime(2024, 1, 31)
CUTOFF = dt.datetime(1997, 1, 1)


def ingest_known(spark, sf_dir):
    """Of the newer half of the modules: which contents an application had already, counted."""
    rows = modules(spark, sf_dir, labels=False).select("id", "app", "body_sha256")
    flagged = keys.already_there(rows.where("id % 2 = 1"), rows.where("id % 2 = 0"), ["app", "body_sha256"])
    return flagged.groupBy("app", "known").agg(F.count("*").alias("n"))


def ingest_pruned(spark, sf_dir):
    """Lines of orders after a sweep that kept the first two lines of every third order; other orders weren't swept."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    kept = rows.where("l_orderkey % 3 = 0 AND l_linenumber <= 2")
    return keys.prune_absent(rows, kept, "l_orderkey", "l_linenumber").groupBy("l_orderkey").agg(F.count("*").alias("n"))


def retention_kept(spark, sf_dir):
    """Snapshots that a collection of old ones leaves."""
    snaps = snapshots(spark, sf_dir)
    gone = changes.gc_candidates(snaps, "kb_id", ["epoch"], 3, "captured_at", F.lit(CUTOFF).cast("timestamp_ntz"))
    return snaps.select("id", "kb_id", "epoch").join(gone.select("id"), "id", "left_anti")


def next_epoch(spark, sf_dir):
    entries = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("kb_id"))
    return keys.next_number(entries, snapshots(spark, sf_dir), "kb_id", "epoch")


def freshness(spark, sf_dir):
    """The moment up to which every source is known: the least of their last ones."""
    last = table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("last"))
    return last.agg(F.min("last").alias("fresh_until"), F.count("*").alias("sources"))


def retry_modules(spark, sf_dir):
    """Users with failures of one class, each once."""
    return usage(spark, sf_dir).where("event_type = 'error' AND cmd % 5 = 1").select("user_id").distinct()


def type_histogram(spark, sf_dir):
    """Pages by extension and by kind of file, and in all."""
    ext = F.regexp_extract(F.regexp_extract("url", "^[^?#]*", 0), r"(\.[a-z]{2,4})$", 1)
    kind = F.when(ext == ".html", "page").when(ext == "", "folder").otherwise("other")
    rows = table(spark, sf_dir, "pages").select(ext.alias("ext"), kind.alias("kind"))
    return rows.rollup("kind", "ext").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


#: Conditions on the lines of an order that say which of twelve dimensions it covers.
PROBES = {f"dim{k:02d}": f"sum(CASE WHEN l_partkey % 12 = {k} THEN 1 ELSE 0 END) > 0" for k in range(12)}


def depth_score(spark, sf_dir):
    """Share of covered dimensions in whole percent, and which are covered and which are missing."""
    probed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.expr(c).alias(n) for n, c in PROBES.items()])
    covered, missing = S.coverage([(n, F.col(n)) for n in PROBES])
    return probed.select("l_orderkey", F.round(F.size(covered) / len(PROBES) * 100).cast("int").alias("score"), F.array_join(covered, ",").alias("covered"), F.array_join(missing, ",").alias("missing"))


def capped_risk(spark, sf_dir):
    """Risk of customers from returned lines, urgent orders and debt, each term capped, and the sum as well."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count("*").alias("orders"))
    rows = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left").fillna(0, ["urgent", "orders"])
    debt = F.when(F.col("c_acctbal") < 0, 25).otherwise(0)
    total = F.least(S.capped(F.col("urgent"), 8, 30) + S.capped(F.col("orders"), 3, 45) + debt, F.lit(100)).cast("long")
    return rows.select("c_custkey", total.alias("risk"), S.risk_level(total).alias("level"))


def findings_top(spark, sf_dir):
    """The twenty worst lines by severity rank, then weight, then key."""
    rank = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", rank.alias("rank"), F.col("l_quantity").alias("weight"))
    return rows.orderBy(F.desc("rank"), F.desc("weight"), "l_orderkey", "l_linenumber", "l_partkey").limit(20)


def weight_trace(spark, sf_dir):
    """The three heaviest lines of each order, as ``part=weight``."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_quantity").cast("int").alias("w"))
    top = changes.first_of_group(rows, ["l_orderkey"], [F.desc("w"), "l_partkey", "l_linenumber"], 3)
    trace = F.sort_array(F.collect_list(F.struct("place", F.concat_ws("=", F.col("l_partkey").cast("string"), F.col("w").cast("string")).alias("t"))))
    return top.groupBy("l_orderkey").agg(F.array_join(trace.t, ", ").alias("trace"))


def canonical_order(spark, sf_dir):
    """Priorities with their numbers of orders, in the order of a fixed list; those not in it come last."""
    order = F.create_map(*[x for n, p in enumerate(("3-MEDIUM", "1-URGENT", "5-LOW")) for x in (F.lit(p), F.lit(n))])
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return rows.withColumn("place", F.coalesce(F.try_element_at(order, "o_orderpriority"), F.lit(3))).orderBy("place", "o_orderpriority")


def dimension_counts(spark, sf_dir):
    """Orders by a column that a caller names, if it is on the list."""
    rows = table(spark, sf_dir, "orders")
    return keys.count_by_allowed(rows, "o_orderstatus", ("o_orderstatus", "o_orderpriority"))


def stability_gate(spark, sf_dir):
    """Whether the last runs of each source are stable: three at least, and all of them precise enough; no review is an error."""
    runs = modules(spark, sf_dir).where("quality IS NOT NULL").groupBy("app", "lang").agg(F.count("*").alias("reviewed"), F.count_if(F.col("quality") == 1).alias("correct"))
    precise = S.ratio(F.col("correct"), F.col("reviewed")) >= 0.5
    return runs.groupBy("app").agg(F.count("*").alias("runs"), ((F.count("*") >= 3) & F.bool_and(precise)).alias("stable"))


def cost_tokens_split(spark, sf_dir):
    """Cost units of users split into input and output, nine to one, the output taking what is left."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.floor(F.col("value") * 100)).alias("total"))
    return rows.select("user_id", "total", F.expr("total * 9 div 10").alias("input"), F.expr("total - total * 9 div 10").alias("output"))


def drift_guarded(spark, sf_dir):
    """Relative change of each user's success rate between the halves of January, judged with 25 events on both sides at least."""
    half = F.when(F.col("ts") < F.lit(dt.datetime(2024, 1, 16)).cast("timestamp_ntz"), "b").otherwise("r")
    rows = table(spark, sf_dir, "events").select(F.expr("user_id % 10").alias("run"), half.alias("half"), (F.col("event_type") != "error").cast("int").alias("ok"))
    both = rows.groupBy("run").agg(*[f.alias(f"{h}_{n}") for h in "br" for n, f in (("n", F.count_if(F.col("half") == h)), ("ok", F.sum(F.when(F.col("half") == h, F.col("ok")))))])
    delta = S.relative_delta(F.col("r_ok") / F.col("r_n"), F.col("b_ok") / F.col("b_n"))
    enough = (F.col("b_n") >= 25) & (F.col("r_n") >= 25)
    return both.where("b_n > 0 AND r_n > 0").select("run", F.round(delta, 9).alias("delta"), (enough & (F.abs(delta) >= 0.2)).alias("drifted"))


def time_forms(spark, sf_dir):
    """Milliseconds, a browser's microseconds since 1601 and back, age and text of every event's time."""
    ts = F.col("ts")
    ms, chromium = T.to_millis(ts), T.to_chromium(ts)
    back = (T.from_millis(ms) == F.date_trunc("second", ts.cast("timestamp"))) & (T.from_chromium(chromium) == ts.cast("timestamp"))
    whole = F.date_trunc("second", ts.cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", T.to_millis(whole).alias("ms"), T.to_chromium(whole).alias("chromium"), T.age_seconds(whole, NOW).alias("age"), T.iso(whole).alias("iso"), F.coalesce(back | (T.from_millis(ms) != whole), F.lit(False)).alias("round_trip"))


def grace_links(spark, sf_dir):
    """Events of a user that were seen no earlier than a minute before the user's last purchase."""
    rows = table(spark, sf_dir, "events")
    source = rows.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("captured"))
    return T.within_grace(rows.select("event_id", "user_id", "ts"), source, "user_id", "ts", "captured", 60).select("event_id", "user_id")


def merged_streams(spark, sf_dir):
    """Events and orders as one sequence: by time, then source, then number; each with its number within its day."""
    a = table(spark, sf_dir, "events").select("ts", F.lit("cdp").alias("stream"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"))
    b = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), F.lit("fs").alias("stream"), F.col("o_orderkey").alias("seq"), events.file_category(F.lower("o_orderpriority")).alias("type"))
    return events.merged([a, b.where("type IS NOT NULL")], "ts", ["stream", "seq"]).select("day", "number", "stream", "seq", "type")


def changes_of_all(spark, sf_dir):
    """Events whose type differs from that of the event before, whoever it was."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return events.changes_of_all(rows, "ts", "event_id", "event_type").select("event_id", "event_type")


def noise_flag(spark, sf_dir):
    """Symbol lists of every order and whether they say nothing: lists of its lines' flags and parts in fields of all kinds."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    word = F.element_at(F.array(*[F.lit(w) for w in ("run", "While", "[a-z]", "go", "open")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    flags = F.array_join(F.sort_array(F.collect_set(quoted("l_returnflag"))), ",")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        flags.alias("flags"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("l_linenumber") > 4, quoted(word)))), ",").alias("names"), F.max("l_linenumber").alias("n")
    )
    k, names = F.col("l_orderkey"), F.col("names")
    field = F.element_at(F.array(*[F.lit(f) for f in ("methods", "urls", "types", "classes")]), (k % 4 + 1).cast("int"))
    extra = F.element_at(F.array(*[F.lit(f) for f in ('"x":[]', '"x":{"y":1}', '"x":3', '"x":[1]', '"x":null', '"x":["a",null]', '"x":["[0-9]",7]')]), (k % 7 + 1).cast("int"))
    lists = F.concat(F.lit('{"'), field, F.lit('":['), names, F.lit("],"), extra, F.lit("}"))
    symbols = F.when(k % 11 == 0, F.lit(" ")).when(k % 11 == 1, F.lit("{}")).when(k % 11 == 2, F.concat(F.lit("["), names, F.lit("]"))).when(k % 11 == 3, F.concat(F.lit('{"functions":['), "flags", F.lit("]}"))).otherwise(lists)
    return lines.select("l_orderkey", S.is_noise(symbols).alias("noisy"))


def diff_identifiers(spark, sf_dir):
    """Identifiers of changes by their category; long digests are cut to sixteen characters."""
    category = F.element_at(F.array(*[F.lit(c) for c in ("dep", "cert", "risk", "module", "capability", "file")]), (F.col("l_partkey") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", category.alias("category"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("digest"))
    name = F.when(F.col("category") == "capability", F.concat(F.lit("uap:"), "l_partkey")).when(F.col("category") == "dep", F.concat(F.lit("d"), "l_partkey")).otherwise(F.col("digest"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "category", S.diff_identifier(F.col("category"), name).alias("identifier"))


QUERIES = {
    f.__name__: f
    for f in (
        ingest_known, ingest_pruned, retention_kept, next_epoch, freshness, retry_modules, type_histogram, depth_score,
        capped_risk, findings_top, weight_trace, canonical_order, dimension_counts, stability_gate, cost_tokens_split,
        drift_guarded, time_forms, grace_links, merged_streams, changes_of_all, noise_flag, diff_identifiers,
    )
}

_DIMS = ", ".join(f"count(*) FILTER (WHERE l_partkey % 12 = {k}) > 0" for k in range(12))

ORACLE_SQL = {
    "ingest_known": """WITH m AS (SELECT doc_id AS id, source AS app, sha256(text) AS h FROM documents)
        SELECT app, EXISTS (SELECT 1 FROM m o WHERE o.id % 2 = 0 AND o.app = n.app AND o.h = n.h) AS known, count(*) AS n FROM m n WHERE id % 2 = 1 GROUP BY 1, 2""",
    "ingest_pruned": """SELECT l_orderkey, count(*) AS n FROM lineitem l WHERE l_linenumber <= 2 OR l_orderkey % 3 <> 0
          OR NOT EXISTS (SELECT 1 FROM lineitem k WHERE k.l_orderkey = l.l_orderkey AND k.l_linenumber <= 2) GROUP BY 1""",
    "retention_kept": """WITH s AS (SELECT o_orderkey AS id, o_custkey AS kb_id, o_orderdate AS made, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS epoch,
                   row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
        SELECT id, kb_id, epoch FROM s WHERE rn <= 3 OR made >= TIMESTAMP '1997-01-01'""",
    "next_epoch": "SELECT c_custkey AS kb_id, CAST(coalesce((SELECT count(*) FROM orders WHERE o_custkey = c_custkey), 0) + 1 AS INTEGER) AS next FROM customer",
    "freshness": "SELECT min(last) AS fresh_until, count(*) AS sources FROM (SELECT max(ts) AS last FROM events GROUP BY event_type)",
    "retry_modules": "SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 = 1",
    "type_histogram": r"""WITH p AS (SELECT regexp_extract(regexp_extract(url, '^[^?#]*'), '(\.[a-z]{2,4})$', 1) AS ext FROM pages
        ), k AS (SELECT ext, CASE ext WHEN '.html' THEN 'page' WHEN '' THEN 'folder' ELSE 'other' END AS kind FROM p)
        SELECT kind, ext, count(*) AS n, CAST(grouping(kind, ext) AS INTEGER) AS level FROM k GROUP BY ROLLUP (kind, ext)""",
    "depth_score": f"""WITH d AS (SELECT l_orderkey, [{_DIMS}] AS hit FROM lineitem GROUP BY 1), n AS (SELECT *, list_transform(range(0, 12), lambda k: 'dim' || lpad(CAST(k AS VARCHAR), 2, '0')) AS names FROM d)
        SELECT l_orderkey, CAST(round(len(list_filter(hit, lambda x: x)) / 12 * 100) AS INTEGER) AS score,
               array_to_string(list_filter(names, lambda x, i: hit[i]), ',') AS covered, array_to_string(list_filter(names, lambda x, i: NOT hit[i]), ',') AS missing FROM n""",
    "capped_risk": """WITH o AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS u FROM orders GROUP BY 1
        ), r AS (SELECT c_custkey, CAST(least(least(coalesce(u, 0) * 8, 30) + least(coalesce(n, 0) * 3, 45) + CASE WHEN c_acctbal < 0 THEN 25 ELSE 0 END, 100) AS BIGINT) AS risk
            FROM customer LEFT JOIN o ON o_custkey = c_custkey)
        SELECT *, CASE WHEN risk >= 75 THEN 'critical' WHEN risk >= 50 THEN 'high' WHEN risk >= 25 THEN 'medium' ELSE 'low' END AS level FROM r""",
    "findings_top": """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END AS rank, l_quantity AS weight FROM lineitem
        ORDER BY rank DESC, weight DESC, l_orderkey, l_linenumber, l_partkey LIMIT 20""",
    "weight_trace": """WITH t AS (SELECT l_orderkey, l_partkey || '=' || CAST(l_quantity AS INTEGER) AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_quantity AS INTEGER) DESC, l_partkey, l_linenumber) AS place FROM lineitem)
        SELECT l_orderkey, string_agg(t, ', ' ORDER BY place) AS trace FROM t WHERE place <= 3 GROUP BY 1""",
    "canonical_order": """SELECT o_orderpriority, count(*) AS n, CASE o_orderpriority WHEN '3-MEDIUM' THEN 0 WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN 2 ELSE 3 END AS place FROM orders GROUP BY 1""",
    "dimension_counts": "SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1",
    "stability_gate": """WITH r AS (SELECT source AS app, lang, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS ok FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NOT NULL GROUP BY 1, 2)
        SELECT app, count(*) AS runs, count(*) >= 3 AND bool_and(ok / n >= 0.5) AS stable FROM r GROUP BY 1""",
    "cost_tokens_split": """WITH c AS (SELECT user_id, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1)
        SELECT user_id, total, total * 9 // 10 AS input, total - total * 9 // 10 AS output FROM c""",
    "drift_guarded": """WITH h AS (SELECT user_id % 10 AS run, ts < TIMESTAMP '2024-01-16' AS early, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') / count(*) AS rate FROM events GROUP BY 1, 2
        ), b AS (SELECT o.run, (r.rate - o.rate) / greatest(o.rate, 0.01) AS delta, o.n >= 25 AND r.n >= 25 AS enough FROM h o JOIN h r ON o.run = r.run AND o.early AND NOT r.early)
        SELECT run, round(delta, 9) AS delta, enough AND abs(delta) >= 0.2 AS drifted FROM b""",
    "time_forms": """WITH s AS (SELECT event_id, date_trunc('second', ts) AS t FROM events)
        SELECT event_id, epoch_ms(t) AS ms, epoch_us(t) + 11644473600000000 AS chromium, CAST(epoch(TIMESTAMP '2024-01-31' - t) AS BIGINT) AS age,
               strftime(t, '%Y-%m-%dT%H:%M:%S') || '+00' AS iso, true AS round_trip FROM s""",
    "grace_links": """SELECT e.event_id, e.user_id FROM events e JOIN (SELECT user_id, max(ts) AS captured FROM events WHERE event_type = 'purchase' GROUP BY 1) s
          ON s.user_id = e.user_id AND e.ts >= s.captured - INTERVAL 60 SECOND""",
    "merged_streams": """WITH u AS (SELECT ts, 'cdp' AS stream, event_id AS seq, event_type AS type FROM events
            UNION ALL SELECT o_orderdate, 'fs', o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'create' WHEN '2-HIGH' THEN 'modify' WHEN '5-LOW' THEN 'delete' END FROM orders)
        SELECT CAST(ts AS DATE) AS day, CAST(row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, stream, seq) AS INTEGER) AS number, stream, seq, type FROM u WHERE type IS NOT NULL""",
    "changes_of_all": """SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type""",
    "noise_flag": r"""WITH w AS (SELECT *, '"' || (['run', 'While', '[a-z]', 'go', 'open'])[l_partkey % 5 + 1] || '"' AS word FROM lineitem
        ), g AS (SELECT l_orderkey AS k, coalesce(string_agg(DISTINCT word, ',' ORDER BY word) FILTER (WHERE l_linenumber > 4), '') AS names, string_agg(DISTINCT '"' || l_returnflag || '"', ',' ORDER BY '"' || l_returnflag || '"') AS flags FROM w GROUP BY 1
        ), s AS (SELECT k, CASE k % 11 WHEN 0 THEN ' ' WHEN 1 THEN '{}' WHEN 2 THEN '[' || names || ']' WHEN 3 THEN '{"functions":[' || flags || ']}'
              ELSE '{"' || (['methods', 'urls', 'types', 'classes'])[k % 4 + 1] || '":[' || names || '],' || (['"x":[]', '"x":{"y":1}', '"x":3', '"x":[1]', '"x":null', '"x":["a",null]', '"x":["[0-9]",7]'])[k % 7 + 1] || '}' END AS j FROM g
        ), o AS (SELECT k, CASE WHEN json_valid(j) AND json_type(j) = 'OBJECT' THEN CAST(j AS JSON) END AS j FROM s
        ), f AS (SELECT k, unnest(json_keys(j)) AS name, j FROM o WHERE j IS NOT NULL
        ), t AS (SELECT k, name, json_type(j, '$.' || name) AS kind, from_json(json_extract(j, '$.' || name), '["JSON"]') AS xs FROM f WHERE json_type(j, '$.' || name) = 'ARRAY'
            UNION ALL SELECT k, name, json_type(j, '$.' || name), [] FROM f WHERE json_type(j, '$.' || name) <> 'ARRAY'
        ), l AS (SELECT k, name, kind = 'NULL' OR (kind = 'ARRAY' AND len(list_filter(xs, lambda x: json_type(x) NOT IN ('VARCHAR', 'NULL'))) = 0) AS listed, list_transform(xs, lambda x: json_extract_string(x, '$')) AS xs FROM t
        ), n AS (SELECT k, bool_or(listed AND len(list_filter(xs, lambda x: regexp_matches(x, '^\[[\^]?[A-Za-z0-9\\.\-_^$|?*+(){}\[\]]{1,20}\]$') OR (name IN ('methods', 'functions', 'classes', 'types') AND lower(x) IN ('while', 'go')))) > 0)
                   OR bool_and(listed AND len(xs) = 0) AS noisy FROM l GROUP BY 1)
        SELECT o.k AS l_orderkey, coalesce(noisy, true) AS noisy FROM o LEFT JOIN n ON n.k = o.k""",
    "diff_identifiers": """WITH c AS (SELECT *, CAST(l_partkey % 6 AS INTEGER) AS w, sha256(CAST(l_partkey AS VARCHAR)) AS d FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_partkey, ['dep', 'cert', 'risk', 'module', 'capability', 'file'][w + 1] AS category,
               CASE w WHEN 0 THEN 'd' || l_partkey WHEN 2 THEN 'risk-score' WHEN 4 THEN 'uap:' || l_partkey ELSE substr(d, 1, 16) END AS identifier FROM c""",
}
