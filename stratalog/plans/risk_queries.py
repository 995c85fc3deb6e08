"""Risk of orders: each line is a capability, the status of the order its signature."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.operators.capability_risk import Rubric, capability_risk
from stratalog.plans.tables import table

RUBRIC = Rubric(
    weights={f"cap{i}": w for i, w in enumerate((5, 40, 0, 15, 60, 2, 25, 10))},
    unknown_weight=12,
    critical_namespaces=("rescap",),
    critical_names=("cap13",),
    multipliers={"F": 0.5, "O": 1.3},
    capped_status="F",
    pins={"cap5": "medium", "cap7": "critical", "cap2": "nothing"},
    namespaces={"windows10/11": "uap6", "windows10/10": "rescap"},
)


def capability_levels(spark, sf_dir):
    """Value, level and evidence of every order."""
    line = table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("cap"), F.col("l_partkey") % 14)
    space = F.when(F.col("l_suppkey") % 90 == 0, "rescap").when(F.col("l_suppkey") % 70 == 1, "unknown:http://x/windows10/10").when(F.col("l_suppkey") % 7 == 2, "unknown:unknown:foundation").otherwise("uap")
    caps = line.where("l_linenumber < 5").select("l_orderkey", (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("place"), space.alias("space"), name.alias("name"))
    apps = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    found = capability_risk(apps, caps, "l_orderkey", "o_orderstatus", "place", "space", "name", RUBRIC)
    return found.withColumn("evidence", F.array_join("evidence", "; "))


QUERIES = {f.__name__: f for f in (capability_levels,)}

ORACLE_SQL = {
    "capability_levels": """WITH c AS (SELECT l_orderkey, l_linenumber * 1000000 + l_partkey AS place, 'cap' || (l_partkey % 14) AS cap, l_partkey % 14 AS i, l_suppkey % 90 = 0 OR l_suppkey % 70 = 1 OR l_partkey % 14 = 13 AS critical FROM lineitem WHERE l_linenumber < 5
        ), w AS (SELECT *, CASE WHEN i < 8 THEN ([5, 40, 0, 15, 60, 2, 25, 10])[i + 1] WHEN NOT critical THEN 12 END AS w, i >= 8 AND NOT critical AS unknown, CASE i WHEN 5 THEN 1 WHEN 7 THEN 3 END AS pin FROM c
        ), p AS (SELECT l_orderkey, sum(w) AS total, bool_or(critical) AS critical, bool_or(unknown) AS unknown,
                   coalesce(string_agg(CASE WHEN critical THEN 'rescap auto-critical: ' || cap ELSE 'unknown_capability:' || cap END || '; ', '' ORDER BY place, cap) FILTER (WHERE critical OR unknown), '') AS said,
                   list('; ' || cap || ' +' || w ORDER BY -w, place, cap) FILTER (WHERE w IS NOT NULL) AS trace FROM w GROUP BY 1
        ), v AS (SELECT o_orderkey AS k, o_orderstatus AS status, p.*, least(greatest(coalesce(total, 0), 0), 100) AS base, CASE o_orderstatus WHEN 'F' THEN 0.5 WHEN 'O' THEN 1.3 ELSE 1.0 END AS m FROM orders LEFT JOIN p ON l_orderkey = o_orderkey
        ), r AS (SELECT *, least(CAST(floor(base * CAST(m AS DOUBLE)) AS INTEGER), 100) AS value FROM v
        ), s AS (SELECT *, CASE WHEN value <= 24 THEN 0 WHEN value <= 49 THEN 1 WHEN value <= 74 THEN 2 ELSE 3 END AS r0 FROM r
        ), t AS (SELECT *, CASE WHEN status = 'F' THEN least(r1, 2) ELSE r1 END AS r2 FROM (SELECT *, CASE WHEN unknown THEN greatest(r0, 2) ELSE r0 END AS r1 FROM s)
        ), q AS (SELECT k, place, cap, pin, greatest(r2, coalesce(max(pin) OVER (PARTITION BY k ORDER BY place, cap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS before FROM t JOIN w ON w.l_orderkey = k WHERE pin IS NOT NULL AND NOT critical_of(t.critical)
        ), l AS (SELECT k, max(pin) AS pin, coalesce(string_agg('; level_override:' || cap || '->' || (['low', 'medium', 'high', 'critical'])[pin + 1], '' ORDER BY place, cap) FILTER (WHERE pin > before), '') AS lifts FROM q GROUP BY 1)
        SELECT t.k AS l_orderkey, value, (['low', 'medium', 'high', 'critical'])[CASE WHEN critical THEN 3 ELSE greatest(r2, coalesce(pin, 0)) END + 1] AS level, CAST(base AS INTEGER) AS base, CAST(m AS DOUBLE) AS multiplier,
               CASE WHEN total IS NULL AND said IS NULL THEN 'no capabilities; ' ELSE coalesce(said, '') END || CASE WHEN status NOT IN ('F', 'O') THEN 'unknown signature status: ' || status || '; ' ELSE '' END
               || status || ' multiplier ' || CAST(CAST(m AS DECIMAL(3, 1)) AS VARCHAR) || CASE WHEN critical THEN '' ELSE coalesce(lifts, '') END || coalesce(array_to_string(trace[1:3], ''), '') AS evidence
        FROM t LEFT JOIN l ON l.k = t.k""".replace("NOT critical_of(t.critical)", "NOT coalesce(t.critical, false)"),
}
