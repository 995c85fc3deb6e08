"""Queries on usage events and runs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stratalog.functions import score as S
from stratalog.functions import text as X
from stratalog.operators import changes, events, keys
from stratalog.plans.tables import USAGE_SQL, table, usage

NOW = dt.datetime(2024, 1, 31)
_KINDS = {"invocations": "click", "failures": "error", "retries": "view"}


def command_rollup(spark, sf_dir):
    return events.rollup(usage(spark, sf_dir), ["cmd"], "event_type", _KINDS)


def window_rollup(spark, sf_dir):
    """The same over the last seven days."""
    recent = usage(spark, sf_dir).where(F.col("ts") >= F.lit(NOW - dt.timedelta(days=7)).cast("timestamp_ntz"))
    return events.rollup(recent, ["cmd"], "event_type", _KINDS)


def _jumps(spark, sf_dir):
    hits = F.count(F.when(F.col("event_type").isin("click", "view"), 1))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(hits.alias("jumps"))


def goal_quantiles(spark, sf_dir):
    """Median (upper middle), 95th percentile by index and largest number of jumps of a goal."""
    return events.index_quantiles(_jumps(spark, sf_dir), "jumps", {"median": 0.5, "p95": 0.95})


def failure_topk(spark, sf_dir):
    message = F.substring(F.concat(F.lit("failed: "), "props"), 1, 80)
    failed = table(spark, sf_dir, "events").where("event_type = 'error'").select(message.alias("message"))
    return failed.groupBy("message").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "message").limit(10)


def _metrics(rows, group):
    counted = rows.groupBy(*group).agg(
        F.count("*").alias("processed"),
        F.count(F.when(F.col("event_type") != "error", 1)).alias("succeeded"),
        F.count(F.when(F.col("event_type") == "view", 1)).alias("escalated"),
        F.count(F.when(F.col("event_type") == "purchase", 1)).alias("flagged"),
        F.sum(F.floor(F.col("value") * 100)).alias("cost"),
    )
    rate = lambda c: S.ratio(F.col(c), F.col("processed"))
    return counted.select(
        *group,
        "processed",
        rate("succeeded").alias("success_rate"),
        rate("escalated").alias("escalation_rate"),
        rate("flagged").alias("human_review_rate"),
        rate("cost").alias("mean_cost"),
    )


def drift_metrics(spark, sf_dir):
    return _metrics(table(spark, sf_dir, "events"), ["user_id"])


def drift_compare(spark, sf_dir):
    """Relative changes of four metrics between the two halves of January; a fifth or more is drift."""
    half = F.when(F.col("ts") < F.lit(dt.datetime(2024, 1, 16)).cast("timestamp_ntz"), "baseline").otherwise("recent")
    rows = _metrics(table(spark, sf_dir, "events").withColumn("half", half), ["user_id", "half"])
    names = ["success_rate", "escalation_rate", "human_review_rate", "mean_cost"]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names]))
    long = rows.select("user_id", "half", each.alias("m")).groupBy("user_id", "m.metric").agg(
        F.max(F.when(F.col("half") == "baseline", F.col("m.v"))).alias("baseline_value"), F.max(F.when(F.col("half") == "recent", F.col("m.v"))).alias("recent_value")
    )
    both = long.where("baseline_value IS NOT NULL AND recent_value IS NOT NULL")
    delta = S.relative_delta(F.col("recent_value"), F.col("baseline_value"))
    return both.withColumn("relative_delta", delta).withColumn("drifted", F.abs("relative_delta") >= 0.2)


def cost_rollup(spark, sf_dir):
    """Cost in hundredths in all, by user and by type of event: three grains in one pass."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor(F.col("value") * 100).alias("cost"))
    return rows.groupingSets([[], [F.col("user_id")], [F.col("event_type")]], "user_id", "event_type").agg(
        F.sum("cost").alias("cost"), F.count("*").alias("n")
    )


def cost_remainder_split(spark, sf_dir):
    """100,003 units split evenly over each user's events; the last event takes the remainder."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts").withColumn("total", F.lit(100_003))
    return events.split_with_remainder(rows, "user_id", ["ts", "event_id"], "total").select("event_id", "user_id", "share")


def stance_status_summary(spark, sf_dir):
    """Counts by type and by day of the week, side by side."""
    rows = table(spark, sf_dir, "events").select("event_type", F.weekday("ts").cast("string").alias("day"))
    return rows.groupingSets([[F.col("event_type")], [F.col("day")]], "event_type", "day").agg(F.count("*").alias("n"))


def last_failure_per_entity(spark, sf_dir):
    failed = table(spark, sf_dir, "events").where("event_type = 'error'")
    return keys.latest(failed, "user_id", F.struct("ts", "event_id"), ["event_id", "ts", "props"])


def stale_runs(spark, sf_dir):
    """Users whose last event lies more than a day before the end of January."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return last.where(F.col("last_seen") < F.lit(NOW - dt.timedelta(days=1)).cast("timestamp_ntz"))


def resumable_runs(spark, sf_dir):
    """The newest run of each user and command, if it was seen in the last five days."""
    newest = usage(spark, sf_dir).groupBy("user_id", "cmd").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))
    return newest.where(F.col("ts") >= F.lit(NOW - dt.timedelta(days=5)).cast("timestamp_ntz"))


def sliding_failure_guard(spark, sf_dir):
    """Failures that are at least the third of their user within three days."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return events.failure_guard(rows, "user_id", "ts", F.col("event_type") == "error", 3 * 86_400).select("event_id", "user_id", "failures")


def session_timeout(spark, sf_dir):
    """Sessions that a pause of more than a day ends."""
    out = events.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 86_400)
    return out.select("user_id", F.col("session").cast("long").alias("session"), "started", "ended", "n_events")


def change_only_emit(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return events.changes_only(rows, "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


def verdict_flips(spark, sf_dir):
    """How often the type of event changes from one event of a user to the next."""
    kept = change_only_emit(spark, sf_dir)
    return kept.groupBy("user_id").agg((F.count("*") - 1).alias("flips"))


def latest_wins_tombstone(spark, sf_dir):
    """State of a store in which errors delete a key and all other events put it."""
    rows = usage(spark, sf_dir).select(
        F.concat_ws("/", F.col("user_id"), F.col("cmd")).alias("key"),
        F.col("event_id").alias("sequence"),
        F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("type"),
        F.col("event_type").alias("value"),
    )
    return keys.latest_with_tombstones(rows, "key", "sequence", "type", "value").select("key", "sequence", "value")


def error_classes(spark, sf_dir):
    """Failures by class of a message made of the event's type, command and value."""
    words = F.get(F.array(*[F.lit(w) for w in ("context deadline exceeded", "cannot unmarshal json", "prompt too large", "sampling 503", "refused")]), F.pmod(F.col("cmd"), F.lit(5)))
    rows = usage(spark, sf_dir).where("event_type = 'error'").select(X.error_class(words).alias("error_class"))
    return rows.groupBy("error_class").agg(F.count("*").alias("n"))


def event_deltas(spark, sf_dir):
    """Change of the value from one event of a user to the next, in hundredths."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.floor(F.col("value") * 100).alias("cost"))
    return changes.deltas(rows, ["user_id"], ["ts", "event_id"], ["cost"]).select("event_id", "user_id", "cost_delta")


def storage_events(spark, sf_dir):
    """Changes of files that usage events stand for, as events of an application's storage."""
    rows = table(spark, sf_dir, "events")
    folder = F.element_at(F.array(*[F.lit(x) for x in ("/app/Local Storage/", "/app/x/leveldb/", "/app/", "/app/deep/er/", "/other/")]), (F.col("user_id") % 5 + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("Cookies", "000003.ldb", "Preferences", "state.sqlite", "note.txt", "x.log", "Secure Preferences", "main.db")]), (F.col("event_id") % 8 + 1).cast("int"))
    operation = F.when(F.col("event_type") == "click", "create").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "modify").otherwise("chmod")
    changes = rows.select("event_id", F.concat(folder, name).alias("path"), operation.alias("operation"), F.col("value").cast("long").alias("size"))
    return events.storage_events(changes, "path", "operation", "size", "/app").drop("size")


QUERIES = {
    f.__name__: f
    for f in (
        command_rollup, window_rollup, goal_quantiles, failure_topk, drift_metrics, drift_compare, cost_rollup,
        cost_remainder_split, stance_status_summary, last_failure_per_entity, stale_runs, resumable_runs,
        sliding_failure_guard, session_timeout, change_only_emit, verdict_flips, latest_wins_tombstone, error_classes,
        event_deltas, storage_events,
    )
}

_ROLLUP = """SELECT cmd, count(*) FILTER (WHERE event_type = 'click') AS invocations,
               count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) FILTER (WHERE event_type = 'view') AS retries
        FROM usage {where} GROUP BY cmd"""
_RATES = """SELECT *, CASE WHEN invocations > 0 THEN failures / invocations ELSE 0.0 END AS failures_rate,
               CASE WHEN invocations > 0 THEN retries / invocations ELSE 0.0 END AS retries_rate FROM r"""
_METRIC = """count(*) AS processed, count(*) FILTER (WHERE event_type <> 'error') / count(*) AS success_rate,
               count(*) FILTER (WHERE event_type = 'view') / count(*) AS escalation_rate,
               count(*) FILTER (WHERE event_type = 'purchase') / count(*) AS human_review_rate,
               CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) / count(*) AS mean_cost"""
_CHANGED = """changed AS (
            SELECT * FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
            WHERE before IS DISTINCT FROM event_type)"""

ORACLE_SQL = {
    "command_rollup": f"WITH {USAGE_SQL}, r AS ({_ROLLUP.format(where='')}) {_RATES}",
    "window_rollup": f"WITH {USAGE_SQL}, r AS ({_ROLLUP.format(where=chr(32) + 'WHERE ts >= TIMESTAMP ' + repr('2024-01-24'))}) {_RATES}",
    "goal_quantiles": """WITH j AS (SELECT user_id, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS jumps FROM events GROUP BY 1),
        s AS (SELECT list_sort(list(jumps)) AS l, count(*) AS n FROM j)
        SELECT l[CAST(floor(n * 0.5) AS BIGINT) + 1] AS median, l[CAST(floor(n * 0.95) AS BIGINT) + 1] AS p95, l[n] AS max FROM s""",
    "failure_topk": """SELECT substr('failed: ' || props, 1, 80) AS message, count(*) AS n FROM events WHERE event_type = 'error'
        GROUP BY 1 ORDER BY n DESC, message LIMIT 10""",
    "drift_metrics": f"SELECT user_id, {_METRIC} FROM events GROUP BY user_id",
    "drift_compare": f"""WITH m AS (
            SELECT user_id, ts < TIMESTAMP '2024-01-16' AS early, {_METRIC} FROM events GROUP BY 1, 2
        ), long AS (
            SELECT user_id, early, unnest(['success_rate', 'escalation_rate', 'human_review_rate', 'mean_cost']) AS metric,
                   unnest([success_rate, escalation_rate, human_review_rate, mean_cost]) AS v FROM m
        ), both_halves AS (
            SELECT b.user_id, b.metric, b.v AS baseline_value, r.v AS recent_value FROM long b JOIN long r
            ON b.user_id = r.user_id AND b.metric = r.metric AND b.early AND NOT r.early)
        SELECT *, (recent_value - baseline_value) / greatest(baseline_value, 0.01) AS relative_delta,
               abs((recent_value - baseline_value) / greatest(baseline_value, 0.01)) >= 0.2 AS drifted FROM both_halves""",
    "cost_rollup": """SELECT user_id, event_type, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS cost, count(*) AS n
        FROM events GROUP BY GROUPING SETS ((), (user_id), (event_type))""",
    "cost_remainder_split": """SELECT event_id, user_id, 100003 // count(*) OVER u
               + CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = count(*) OVER u THEN 100003 % count(*) OVER u ELSE 0 END AS share
        FROM events WINDOW u AS (PARTITION BY user_id)""",
    "stance_status_summary": """WITH e AS (SELECT event_type, CAST((dayofweek(ts) + 6) % 7 AS VARCHAR) AS day FROM events)
        SELECT event_type, day, count(*) AS n FROM e GROUP BY GROUPING SETS ((event_type), (day))""",
    "last_failure_per_entity": """SELECT DISTINCT ON (user_id) user_id, event_id, ts, props FROM events
        WHERE event_type = 'error' ORDER BY user_id, ts DESC, event_id DESC""",
    "stale_runs": "SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30'",
    "resumable_runs": f"""WITH {USAGE_SQL}
        SELECT * FROM (SELECT DISTINCT ON (user_id, cmd) user_id, cmd, event_id, ts FROM usage ORDER BY user_id, cmd, ts DESC, event_id DESC)
        WHERE ts >= TIMESTAMP '2024-01-26'""",
    "sliding_failure_guard": """WITH f AS (
            SELECT a.event_id, a.user_id, count(*) AS failures FROM events a JOIN events b
              ON a.user_id = b.user_id AND b.ts > a.ts - INTERVAL 3 DAY AND b.ts <= a.ts
            WHERE a.event_type = 'error' AND b.event_type = 'error' GROUP BY 1, 2)
        SELECT event_id, user_id, failures FROM f WHERE failures >= 3""",
    "session_timeout": """WITH g AS (
            SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 86400000000 THEN 1 ELSE 0 END AS new
            FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
        ), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g)
        SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS n_events FROM s GROUP BY 1, 2""",
    "change_only_emit": f"WITH {_CHANGED} SELECT event_id, user_id, event_type FROM changed",
    "verdict_flips": f"WITH {_CHANGED} SELECT user_id, count(*) - 1 AS flips FROM changed GROUP BY user_id",
    "latest_wins_tombstone": f"""WITH {USAGE_SQL}, k AS (SELECT user_id || '/' || cmd AS key, event_id, event_type FROM usage), s AS (
            SELECT key, max(event_id) FILTER (WHERE event_type <> 'error') AS sequence,
                   arg_max(event_type, event_id) FILTER (WHERE event_type <> 'error') AS value,
                   max(event_id) FILTER (WHERE event_type = 'error') AS gone FROM k GROUP BY key)
        SELECT key, sequence, value FROM s WHERE sequence IS NOT NULL AND (gone IS NULL OR gone <= sequence)""",
    "error_classes": f"""WITH {USAGE_SQL}
        SELECT ['timeout', 'json_parse', 'prompt_too_large', 'mcp_sampling_5xx', 'other'][cmd % 5 + 1] AS error_class, count(*) AS n
        FROM usage WHERE event_type = 'error' GROUP BY 1""",
    "event_deltas": """WITH c AS (SELECT *, CAST(floor(value * 100) AS BIGINT) AS cost FROM events)
        SELECT event_id, user_id, cost - lag(cost) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cost_delta FROM c""",
    "storage_events": """WITH c AS (SELECT event_id, (['/app/Local Storage/', '/app/x/leveldb/', '/app/', '/app/deep/er/', '/other/'])[user_id % 5 + 1] AS d,
               (['Cookies', '000003.ldb', 'Preferences', 'state.sqlite', 'note.txt', 'x.log', 'Secure Preferences', 'main.db'])[event_id % 8 + 1] AS b,
               CASE event_type WHEN 'click' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'view' THEN 'modify' ELSE 'chmod' END AS operation, trunc(value) AS size FROM events
        ), k AS (SELECT *, CASE WHEN contains(d, 'Local Storage') THEN 'localstorage' WHEN contains(d, 'leveldb') THEN 'leveldb' WHEN b IN ('Cookies', 'Cookies-journal') THEN 'cookies'
               WHEN b IN ('Preferences', 'Secure Preferences') THEN 'preferences' WHEN suffix(b, '.sqlite') OR suffix(b, '.db') THEN 'sqlite' END AS category FROM c)
        SELECT event_id, CASE WHEN starts_with(d, '/app/') THEN substr(d || b, 6) ELSE d || b END AS path, operation, category, CASE WHEN operation = 'delete' THEN 'storage.delete' ELSE 'storage.write' END AS type,
               CASE WHEN operation = 'delete' THEN 0 ELSE CAST(size AS BIGINT) END AS size_delta FROM k WHERE category IS NOT NULL AND operation <> 'chmod'""",
}
