"""Queries on modules, snapshots and facts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import score as S
from stratalog.functions import text as X
from stratalog.operators import changes, keys
from stratalog.plans.tables import FACTS_SQL, MODULES_SQL, SNAPSHOTS_SQL, facts, modules, snapshots, table

CUTOFF = dt.datetime(1997, 1, 1)


def app_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules, summarised modules, mean body size and distinct bodies of each application."""
    return (
        modules(spark, sf_dir)
        .groupBy("app")
        .agg(
            F.count("*").alias("total"),
            F.count("quality").alias("summarized"),
            F.coalesce(F.avg("body_size"), F.lit(0.0)).alias("avg_body_size"),
            F.countDistinct("body_sha256").alias("distinct_bodies"),
        )
    )


def coverage_pct(spark, sf_dir):
    counted = modules(spark, sf_dir).groupBy("app").agg(F.count("quality").alias("done"), F.count("*").alias("total"))
    return counted.select("app", S.percent(F.col("done"), F.col("total")).alias("coverage_pct"))


def repeat_hash_topk(spark, sf_dir):
    """The most repeated bodies, with the first application that has each."""
    return keys.repeated(modules(spark, sf_dir, labels=False), "body_sha256", "id", "app", 2, 20)


def repeat_hash_totals(spark, sf_dir):
    return repeat_hash_topk(spark, sf_dir).agg(F.count("*").alias("hashes"), F.sum("copies").alias("copies"))


def dedup_representative(spark, sf_dir):
    return keys.representatives(modules(spark, sf_dir, labels=False).select("id", "app", "body_sha256"), ["app", "body_sha256"], ["id"])


def sibling_propagation(spark, sf_dir):
    """Labels spread to modules of the same body."""
    return keys.propagate(modules(spark, sf_dir).select("id", "body_sha256", "quality"), "body_sha256", "id", "quality")


def pending_with_enriched_sibling(spark, sf_dir):
    rows = modules(spark, sf_dir).select("id", "app", "body_sha256", "quality")
    done = rows.where("quality IS NOT NULL").select("body_sha256")
    return rows.where("quality IS NULL").join(done, "body_sha256", "left_semi").select("id", "app", "body_sha256")


def orphan_rows(spark, sf_dir):
    """Entries that no urgent snapshot refers to."""
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left_anti")


def fk_violations(spark, sf_dir):
    """Orders whose customer isn't among those in credit; a null key on either side makes no violation."""
    active = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return keys.not_in(orders, active, "o_custkey", "c_custkey").groupBy("o_custkey").agg(F.count("*").alias("violations"))


def latest_snapshot(spark, sf_dir):
    snaps = snapshots(spark, sf_dir)
    best = keys.latest(snaps, "kb_id", F.struct("captured_at", "id"), ["id", "captured_at", "risk_level"])
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("kb_id"), F.col("c_name").alias("app"))
    return names.join(best, "kb_id", "left")


def latest_nested(spark, sf_dir):
    """The latest snapshot of each entry, and the last line of that snapshot."""
    best = keys.latest(snapshots(spark, sf_dir), "kb_id", F.struct("captured_at", "id"), ["id"])
    lines = keys.latest(table(spark, sf_dir, "lineitem"), "l_orderkey", F.struct("l_linenumber", "l_partkey", "l_quantity"), ["l_linenumber", "l_partkey", "l_quantity"])
    return best.join(lines.withColumnRenamed("l_orderkey", "id"), "id", "left").select("kb_id", "id", "l_linenumber", "l_partkey", "l_quantity")


def _sized_snapshots(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("modules_indexed"))
    return snapshots(spark, sf_dir).join(lines, "id", "left").withColumn("modules_indexed", F.coalesce("modules_indexed", F.lit(0)))


def evolution_delta(spark, sf_dir):
    rows = changes.deltas(_sized_snapshots(spark, sf_dir), ["kb_id"], ["epoch"], ["modules_indexed", "depth_score"])
    return rows.select("kb_id", "epoch", "modules_indexed", "modules_indexed_delta", F.round("depth_score_delta", 2).alias("depth_score_delta"))


def series_summary(spark, sf_dir):
    """Least, largest and last size of each entry's snapshots."""
    return _sized_snapshots(spark, sf_dir).groupBy("kb_id").agg(
        F.min("modules_indexed").alias("least"), F.max("modules_indexed").alias("largest"), F.max_by("modules_indexed", "epoch").alias("last")
    )


def retention_gc(spark, sf_dir):
    """Snapshots to delete: not among the three newest of their entry, and older than the cutoff."""
    return changes.gc_candidates(snapshots(spark, sf_dir), "kb_id", ["epoch"], 3, "captured_at", F.lit(CUTOFF).cast("timestamp_ntz")).select("id", "kb_id", "epoch", "rn")


def empty_snapshots(spark, sf_dir):
    """Snapshots none of whose lines is large."""
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return snapshots(spark, sf_dir).select("id", "kb_id").join(large, "id", "left_anti")


def timeline_counts(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("kb_id", "epoch", "category").agg(F.count("*").alias("n"))


def timeline_payload(spark, sf_dir):
    """One row per epoch with its counts by category, and the change of the total (0 for the first)."""
    counts = facts(spark, sf_dir).groupBy("kb_id", "epoch").agg(
        F.count("*").alias("n"), *[F.count(F.when(F.col("category") == c, 1)).alias(f"n_{c.lower()}") for c in "ANR"]
    )
    return changes.deltas(counts, ["kb_id"], ["epoch"], ["n"], first_is_zero=True)


def body_reuse(spark, sf_dir):
    return modules(spark, sf_dir, labels=False).groupBy("body_sha256").agg(
        F.countDistinct("app").alias("apps"), F.count("*").alias("refs"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


def capture_summary(spark, sf_dir):
    """For each module the number of other applications that have its body."""
    rows = modules(spark, sf_dir, labels=False).select("id", "app", "body_sha256")
    apps = rows.groupBy("body_sha256").agg(F.countDistinct("app").alias("apps"))
    return rows.join(apps, "body_sha256").select("id", "app", (F.col("apps") - 1).alias("other_apps"))


def fact_diff_fullouter(spark, sf_dir):
    """What changed between epoch 1 and 2 of every entry."""
    rows = facts(spark, sf_dir)
    side = lambda e: rows.where(F.col("epoch") == e).drop("epoch")
    return changes.fact_diff(side(1), side(2), ["kb_id", "category", "key"], "value")


def consecutive_diff_all(spark, sf_dir):
    diff = changes.consecutive_diff(facts(spark, sf_dir), "kb_id", "epoch", ["category", "key"], "value")
    return diff.groupBy("kb_id", "epoch", "change_type").agg(F.count("*").alias("n"))


def diff_roles(spark, sf_dir):
    """Counts of changes with both snapshots of each diff: two joins with the snapshot table in two roles."""
    diff = consecutive_diff_all(spark, sf_dir)
    snaps = snapshots(spark, sf_dir).select("kb_id", "epoch", "id")
    to = snaps.withColumnRenamed("id", "to_id")
    before = snaps.select("kb_id", (F.col("epoch") + 1).alias("epoch"), F.col("id").alias("from_id"))
    return diff.join(to, ["kb_id", "epoch"]).join(before, ["kb_id", "epoch"]).groupBy("from_id", "to_id").agg(F.sum("n").alias("n"))


def _names(spark, sf_dir, app, lang=None):
    rows = modules(spark, sf_dir).where((F.col("app") == app) & F.col("quality").isNotNull())
    rows = rows.withColumn("name", F.substring("body_sha256", 1, 8))
    return rows.where(F.col("lang") == lang) if lang else rows


def app_unique(spark, sf_dir):
    """Labelled English modules of one application whose name the other one doesn't have in any language."""
    other = _names(spark, sf_dir, "src2").select("name")
    return _names(spark, sf_dir, "src1", "en").join(other, "name", "left_anti").select("id", "name", "body_size").orderBy(F.desc("body_size"), "id").limit(50)


def app_common_count(spark, sf_dir):
    common = _names(spark, sf_dir, "src1").select("name").intersect(_names(spark, sf_dir, "src2").select("name"))
    return common.agg(F.count("*").alias("common"))


def overlay_provenance(spark, sf_dir):
    """Facts of epoch 1 overlaid with those of epoch 2, counted by provenance."""
    rows = facts(spark, sf_dir)
    side = lambda e: rows.where(F.col("epoch") == e).drop("epoch")
    merged = changes.overlay(side(1), side(2), ["kb_id", "category", "key"], "value")
    return merged.groupBy("kb_id", "provenance").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def token_budget(spark, sf_dir):
    """Modules of each application, shortest first, that fit a budget of 200,000 characters."""
    rows = modules(spark, sf_dir, labels=False).select("id", "app", "body_size")
    return changes.running_budget(rows, "app", ["body_size", "id"], "body_size", 200_000)


def token_ranking(spark, sf_dir):
    """The best modules within bounds: labelled ones first, then the largest; 6000 bytes a module, 300 modules, 60,000 tokens."""
    rows = modules(spark, sf_dir).select("id", F.coalesce("quality", F.lit(-1)).alias("signal"), F.octet_length("body").alias("size"), F.length("body").alias("chars"))
    found = changes.ranked_within_budget(rows, "signal", "size", "id", "chars", most_bytes=6000, most_rows=300, most_tokens=60_000)
    return found.select("id", "signal", "size", "place", "tokens")


def fingerprint(spark, sf_dir):
    """Stable keys of catalogue entries from their names and segments."""
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", X.slug(F.col("c_name")).alias("slug"), X.fingerprint(X.slug(F.col("c_name")), F.lower("c_mktsegment")).alias("kb_id"))


def risk_level_ladder(spark, sf_dir):
    """Levels of a risk score made of each order's price, counted."""
    score = F.least(F.floor(F.col("o_totalprice") / 5000), F.lit(100))
    return table(spark, sf_dir, "orders").select(S.risk_level(score).alias("level")).groupBy("level").agg(F.count("*").alias("n"))


def scorecard_mean10(spark, sf_dir):
    """Ten times the mean of twelve scores as a whole number, and how many reach 80, 50 and 20."""
    score = F.least((F.col("l_quantity") * 2).cast("long"), F.lit(100))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), score.alias("score"))
    reach = lambda bound: F.count(F.when(F.col("score") >= bound, 1)).alias(f"at{bound}")
    return rows.groupBy("id").agg(F.floor(F.sum("score") * 10 / 12).alias("mean10"), reach(80), reach(50), reach(20))


def weighted_bucket_risk(spark, sf_dir):
    """Capped sums of weights per order, a multiplier by priority, and the bucket."""
    weight = F.when(F.col("l_returnflag") == "R", 15).when(F.col("l_returnflag") == "A", 8).otherwise(3)
    base = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.least(F.sum(weight), F.lit(100)).alias("base"))
    times = F.when(F.col("o_orderpriority") == "1-URGENT", 1.5).when(F.col("o_orderpriority") == "5-LOW", 0.5).otherwise(1.0)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(base, "o_orderkey")
    rows = rows.withColumn("value", F.least(F.floor(F.col("base") * times), F.lit(100)))
    return rows.select("o_orderkey", "base", "value", S.risk_level(F.col("value")).alias("level"))


def precision_gate(spark, sf_dir):
    """Share of right labels among reviewed ones by language; stable if at least three reviews reach 0.5."""
    rows = modules(spark, sf_dir).where("quality IS NOT NULL")
    counted = rows.groupBy("lang").agg(F.count("*").alias("reviewed"), F.count(F.when(F.col("quality") == 1, 1)).alias("correct"))
    return counted.select("lang", "reviewed", "correct", S.ratio(F.col("correct"), F.col("reviewed")).alias("precision"),
                          ((F.col("reviewed") >= 3) & (F.col("correct") * 2 >= F.col("reviewed"))).alias("stable"))


QUERIES = {
    f.__name__: f
    for f in (
        app_stats, coverage_pct, repeat_hash_topk, repeat_hash_totals, dedup_representative, sibling_propagation,
        pending_with_enriched_sibling, orphan_rows, fk_violations, latest_snapshot, latest_nested, evolution_delta,
        series_summary, retention_gc, empty_snapshots, timeline_counts, timeline_payload, body_reuse, capture_summary,
        fact_diff_fullouter, consecutive_diff_all, diff_roles, app_unique, app_common_count, overlay_provenance,
        token_budget, token_ranking, fingerprint, risk_level_ladder, scorecard_mean10, weighted_bucket_risk, precision_gate,
    )
}

_REPEATED = """SELECT body_sha256, count(*) AS copies, arg_min(app, id) AS sample FROM modules
        GROUP BY body_sha256 HAVING count(*) >= 2 ORDER BY copies DESC, body_sha256 LIMIT 20"""
_SIZED = (
    SNAPSHOTS_SQL
    + """, sized AS (
    SELECT s.*, coalesce(n, 0) AS modules_indexed FROM snapshots s
    LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l.l_orderkey = s.id)"""
)
_CHANGES = (
    FACTS_SQL
    + """, joined AS (
    SELECT coalesce(a.kb_id, b.kb_id) AS kb_id, coalesce(a.epoch, b.epoch + 1) AS epoch,
           CASE WHEN b.kb_id IS NULL THEN 'added' WHEN a.kb_id IS NULL THEN 'removed' ELSE 'modified' END AS change_type,
           b.value AS old_value, a.value AS new_value
    FROM (SELECT * FROM facts WHERE epoch > 1) a
    FULL OUTER JOIN (SELECT f.* FROM facts f JOIN (SELECT kb_id, max(epoch) AS last FROM facts GROUP BY 1) m
                     ON m.kb_id = f.kb_id AND f.epoch + 1 <= m.last) b
      ON a.kb_id = b.kb_id AND a.epoch = b.epoch + 1 AND a.category = b.category AND a.key = b.key
), changed AS (
    SELECT kb_id, epoch, change_type, count(*) AS n FROM joined
    WHERE change_type <> 'modified' OR old_value IS DISTINCT FROM new_value GROUP BY ALL)"""
)
_NAMES = MODULES_SQL + ", named AS (SELECT *, substr(body_sha256, 1, 8) AS name FROM modules WHERE quality IS NOT NULL)"

ORACLE_SQL = {
    "app_stats": f"""WITH {MODULES_SQL}
        SELECT app, count(*) AS total, count(quality) AS summarized, coalesce(avg(body_size), 0.0) AS avg_body_size,
               count(DISTINCT body_sha256) AS distinct_bodies FROM modules GROUP BY app""",
    "coverage_pct": f"""WITH {MODULES_SQL}
        SELECT app, coalesce(count(quality) * 100 // nullif(count(*), 0), 0) AS coverage_pct FROM modules GROUP BY app""",
    "repeat_hash_topk": f"WITH {MODULES_SQL} {_REPEATED}",
    "repeat_hash_totals": f"""WITH {MODULES_SQL}, top AS ({_REPEATED})
        SELECT count(*) AS hashes, CAST(sum(copies) AS BIGINT) AS copies FROM top""",
    "dedup_representative": f"""WITH {MODULES_SQL}
        SELECT DISTINCT ON (app, body_sha256) id, app, body_sha256 FROM modules ORDER BY app, body_sha256, id""",
    "sibling_propagation": f"""WITH {MODULES_SQL}
        SELECT m.id, m.body_sha256, coalesce(m.quality, r.quality) AS quality FROM modules m
        LEFT JOIN (SELECT body_sha256, arg_min(quality, id) AS quality FROM modules WHERE quality IS NOT NULL GROUP BY 1) r
          ON r.body_sha256 = m.body_sha256""",
    "pending_with_enriched_sibling": f"""WITH {MODULES_SQL}
        SELECT id, app, body_sha256 FROM modules p WHERE quality IS NULL
          AND EXISTS (SELECT 1 FROM modules e WHERE e.body_sha256 = p.body_sha256 AND e.id <> p.id AND e.quality IS NOT NULL)""",
    "orphan_rows": "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')",
    "fk_violations": """SELECT o_custkey, count(*) AS violations FROM orders
        WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey""",
    "latest_snapshot": """SELECT c.c_custkey AS kb_id, c.c_name AS app, o.id, o.captured_at, o.risk_level FROM customer c
        LEFT JOIN LATERAL (SELECT o_orderkey AS id, o_orderdate AS captured_at, o_orderpriority AS risk_level FROM orders
                           WHERE o_custkey = c.c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) o ON true""",
    "latest_nested": f"""WITH {SNAPSHOTS_SQL}
        SELECT s.kb_id, s.id, l.l_linenumber, l.l_partkey, l.l_quantity
        FROM (SELECT DISTINCT ON (kb_id) kb_id, id FROM snapshots ORDER BY kb_id, epoch DESC) s
        LEFT JOIN (SELECT DISTINCT ON (l_orderkey) * FROM lineitem ORDER BY l_orderkey, l_linenumber DESC, l_partkey DESC, l_quantity DESC) l ON l.l_orderkey = s.id""",
    "evolution_delta": f"""WITH {_SIZED}
        SELECT kb_id, epoch, modules_indexed, modules_indexed - lag(modules_indexed) OVER w AS modules_indexed_delta,
               round(depth_score - lag(depth_score) OVER w, 2) AS depth_score_delta
        FROM sized WINDOW w AS (PARTITION BY kb_id ORDER BY epoch)""",
    "series_summary": f"""WITH {_SIZED}
        SELECT kb_id, min(modules_indexed) AS least, max(modules_indexed) AS largest, arg_max(modules_indexed, epoch) AS last
        FROM sized GROUP BY kb_id""",
    "retention_gc": f"""WITH {SNAPSHOTS_SQL}, ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY kb_id ORDER BY epoch DESC) AS INTEGER) AS rn FROM snapshots)
        SELECT id, kb_id, epoch, rn FROM ranked WHERE rn > 3 AND captured_at < TIMESTAMP '1997-01-01'""",
    "empty_snapshots": """SELECT o_orderkey AS id, o_custkey AS kb_id FROM orders o
        WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)""",
    "timeline_counts": f"WITH {FACTS_SQL} SELECT kb_id, epoch, category, count(*) AS n FROM facts GROUP BY ALL",
    "timeline_payload": f"""WITH {FACTS_SQL}, counts AS (
            SELECT kb_id, epoch, count(*) AS n, count(*) FILTER (WHERE category = 'A') AS n_a,
                   count(*) FILTER (WHERE category = 'N') AS n_n, count(*) FILTER (WHERE category = 'R') AS n_r
            FROM facts GROUP BY kb_id, epoch)
        SELECT *, coalesce(n - lag(n) OVER (PARTITION BY kb_id ORDER BY epoch), 0) AS n_delta FROM counts""",
    "body_reuse": f"""WITH {MODULES_SQL}
        SELECT body_sha256, count(DISTINCT app) AS apps, count(*) AS refs, min(id) AS first_id, max(id) AS last_id
        FROM modules GROUP BY body_sha256""",
    "capture_summary": f"""WITH {MODULES_SQL}
        SELECT m.id, m.app, r.apps - 1 AS other_apps FROM modules m
        JOIN (SELECT body_sha256, count(DISTINCT app) AS apps FROM modules GROUP BY 1) r ON r.body_sha256 = m.body_sha256""",
    "fact_diff_fullouter": f"""WITH {FACTS_SQL}, o AS (SELECT * FROM facts WHERE epoch = 1), n AS (SELECT * FROM facts WHERE epoch = 2)
        SELECT coalesce(o.kb_id, n.kb_id) AS kb_id, coalesce(o.category, n.category) AS category, coalesce(o.key, n.key) AS key,
               o.value AS old_value, n.value AS new_value,
               CASE WHEN o.kb_id IS NULL THEN 'added' WHEN n.kb_id IS NULL THEN 'removed' ELSE 'modified' END AS change_type
        FROM o FULL OUTER JOIN n ON o.kb_id = n.kb_id AND o.category = n.category AND o.key = n.key
        WHERE o.value IS DISTINCT FROM n.value""",
    "consecutive_diff_all": f"WITH {_CHANGES} SELECT kb_id, epoch, change_type, n FROM changed",
    "diff_roles": f"""WITH {_CHANGES}
        SELECT f.id AS from_id, t.id AS to_id, CAST(sum(n) AS BIGINT) AS n FROM changed c
        JOIN snapshots t ON t.kb_id = c.kb_id AND t.epoch = c.epoch
        JOIN snapshots f ON f.kb_id = c.kb_id AND f.epoch = c.epoch - 1 GROUP BY f.id, t.id""",
    "app_unique": f"""WITH {_NAMES}
        SELECT id, name, body_size FROM named a WHERE app = 'src1' AND lang = 'en'
          AND NOT EXISTS (SELECT 1 FROM named b WHERE b.app = 'src2' AND b.name = a.name)
        ORDER BY body_size DESC, id LIMIT 50""",
    "app_common_count": f"""WITH {_NAMES}
        SELECT count(*) AS common FROM (SELECT name FROM named WHERE app = 'src1' INTERSECT SELECT name FROM named WHERE app = 'src2')""",
    "overlay_provenance": f"""WITH {FACTS_SQL}, s AS (SELECT * FROM facts WHERE epoch = 1), x AS (SELECT * FROM facts WHERE epoch = 2)
        SELECT coalesce(s.kb_id, x.kb_id) AS kb_id,
               CASE WHEN x.kb_id IS NULL THEN 'static' WHEN s.kb_id IS NULL THEN 'live' ELSE 'both' END AS provenance,
               count(*) AS n, sum(coalesce(x.value, s.value)) AS total
        FROM s FULL OUTER JOIN x ON s.kb_id = x.kb_id AND s.category = x.category AND s.key = x.key GROUP BY 1, 2""",
    "token_budget": """SELECT * FROM (
            SELECT doc_id AS id, source AS app, n_chars AS body_size,
                   CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running
            FROM documents) WHERE running <= 200000""",
    "token_ranking": """WITH m AS (SELECT d.doc_id AS id, coalesce(quality, -1) AS signal, CAST(strlen(text) AS INTEGER) AS size, length(text) // 4 AS t FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE strlen(text) <= 6000
        ), r AS (SELECT id, signal, size, row_number() OVER w AS place, CAST(sum(t) OVER w AS BIGINT) AS tokens FROM m WINDOW w AS (ORDER BY signal DESC, size DESC, id ROWS UNBOUNDED PRECEDING))
        SELECT * FROM r WHERE place <= 300 AND tokens <= 60000""",
    "fingerprint": r"""WITH s AS (SELECT *, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer)
        SELECT c_custkey, slug, substr(sha256(slug || '|' || lower(c_mktsegment)), 1, 16) AS kb_id FROM s""",
    "risk_level_ladder": """WITH s AS (SELECT least(floor(o_totalprice / 5000), 100) AS score FROM orders)
        SELECT CASE WHEN score >= 75 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END AS level,
               count(*) AS n FROM s GROUP BY 1""",
    "scorecard_mean10": """WITH s AS (SELECT l_orderkey AS id, least(CAST(l_quantity * 2 AS BIGINT), 100) AS score FROM lineitem)
        SELECT id, CAST(sum(score) * 10 // 12 AS BIGINT) AS mean10, count(*) FILTER (WHERE score >= 80) AS at80,
               count(*) FILTER (WHERE score >= 50) AS at50, count(*) FILTER (WHERE score >= 20) AS at20 FROM s GROUP BY id""",
    "weighted_bucket_risk": """WITH b AS (
            SELECT l_orderkey, least(sum(CASE l_returnflag WHEN 'R' THEN 15 WHEN 'A' THEN 8 ELSE 3 END), 100) AS base FROM lineitem GROUP BY 1
        ), v AS (
            SELECT o_orderkey, CAST(base AS BIGINT) AS base, CAST(least(floor(base * CASE o_orderpriority WHEN '1-URGENT' THEN 1.5
                   WHEN '5-LOW' THEN 0.5 ELSE 1.0 END), 100) AS BIGINT) AS value FROM orders JOIN b ON l_orderkey = o_orderkey)
        SELECT *, CASE WHEN value >= 75 THEN 'critical' WHEN value >= 50 THEN 'high' WHEN value >= 25 THEN 'medium' ELSE 'low' END AS level FROM v""",
    "precision_gate": f"""WITH {MODULES_SQL}
        SELECT lang, count(*) AS reviewed, count(*) FILTER (WHERE quality = 1) AS correct,
               count(*) FILTER (WHERE quality = 1) / count(*) AS precision,
               count(*) >= 3 AND count(*) FILTER (WHERE quality = 1) * 2 >= count(*) AS stable
        FROM modules WHERE quality IS NOT NULL GROUP BY lang""",
}
