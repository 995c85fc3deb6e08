"""Findings of patterns in documents, with their SQL twins."""

from __future__ import annotations

from stratalog.operators import findings
from stratalog.plans.tables import table

Rule = findings.Rule
RULES = (
    Rule("keyed-value", "data_access", "CRITICAL", 40, (r"(?:token|secret|password) ?[=:] ?[\"']?[A-Za-z0-9]{8,}", r"(?:TOKEN|SECRET|PASSWORD) ?[=:] ?[\"']?[A-Za-z0-9]{8,}"), ("token", "secret", "password")),
    Rule("address", "data_access", "MEDIUM", 10, (r"[a-z0-9.]+@[a-z0-9]+\.[a-z]+",), ("@",)),
    Rule("number-in-groups", "data_access", "HIGH", 20, (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}", "[0-9]{16}")),
    Rule("address-by-numbers", "network", "HIGH", 30, (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",), (".",)),
    Rule("link", "network", "LOW", 5, ("https?://[^ \n\"']+",), ("http",)),
    Rule("licence", "supply_chain", "INFO", 1, ("[Ll]icensed under[^\n]{0,200}", "[Rr]eleased under"), ("ensed under", "released under")),
    Rule("signs", "obfuscation", "LOW", 2, ("[#*$%&|<>]{3,}",)),
    Rule("literal", "execution", "LOW", 3, ("the [ab]",), ("the",)),
)


def _found(spark, sf_dir):
    return findings.scan(table(spark, sf_dir, "documents"), "doc_id", "text", RULES)


def pattern_findings(spark, sf_dir):
    """Every finding with line, offsets, matched text and context."""
    return _found(spark, sf_dir)


def category_scores(spark, sf_dir):
    """Count, score and worst severity by document and category."""
    return findings.by_category(_found(spark, sf_dir), "doc_id")


def threat_levels(spark, sf_dir):
    """Findings, score, level and worst severity of each document that has a finding."""
    return findings.threat(_found(spark, sf_dir), "doc_id")


def worst_findings(spark, sf_dir):
    return findings.top_findings(_found(spark, sf_dir), "doc_id").select("doc_id", "pattern", "line", "start", "matched")


QUERIES = {f.__name__: f for f in (pattern_findings, category_scores, threat_levels, worst_findings)}


def _sql() -> str:
    """The same by pieces: what lies between matches and the matches themselves give the offsets by running sums."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    found = [
        f"SELECT doc_id, text, {quote(r.pattern)} AS pattern, {quote(r.category)} AS category, '{r.severity}' AS severity, {r.weight} AS weight, {k} AS k, "
        f"regexp_extract_all(text, {quote(e)}) AS ms, regexp_split_to_array(text, {quote(e)}) AS bs FROM documents WHERE regexp_matches(text, {quote(e)})"
        for r in RULES
        for k, e in enumerate(r.expressions)
    ]
    return f"""m AS ({' UNION ALL '.join(found)}
        ), e AS (SELECT * EXCLUDE (ms, bs), unnest(ms) AS m, unnest(bs[1:len(ms)]) AS b, generate_subscripts(ms, 1) AS i FROM m
        ), o AS (SELECT *, CAST(sum(length(m) + length(b)) OVER (PARTITION BY doc_id, pattern, k ORDER BY i) AS BIGINT) AS "end" FROM e
        ), p AS (SELECT *, "end" - length(m) AS start FROM o WHERE i <= 50
        ), l AS (SELECT *, CAST(1 + length(substr(text, 1, start)) - length(replace(substr(text, 1, start), chr(10), '')) AS INTEGER) AS line FROM p
        ), f AS (SELECT DISTINCT ON (doc_id, pattern, line) doc_id, pattern, category, severity, weight, line, start, "end",
                   CASE WHEN length(m) > 120 THEN substr(m, 1, 120) || '...' ELSE m END AS matched,
                   replace(replace(substr(text, greatest(start - 60, 0) + 1, "end" + 60 - greatest(start - 60, 0)), chr(10), '↵'), chr(13), '') AS evidence
                 FROM l ORDER BY doc_id, pattern, line, k, start
        ), ranked AS (SELECT *, list_position(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity) AS r FROM f)"""


_SEVERITY = "['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(r)] AS max_severity"
ORACLE_SQL = {
    "pattern_findings": f"WITH {_sql()} SELECT * EXCLUDE (r) FROM ranked",
    "category_scores": f"WITH {_sql()} SELECT doc_id, category, count(*) AS count, CAST(sum(weight) AS BIGINT) AS score, {_SEVERITY} FROM ranked GROUP BY 1, 2",
    "threat_levels": f"""WITH {_sql()}, s AS (SELECT doc_id, count(*) AS findings, CAST(sum(weight) AS BIGINT) AS score, {_SEVERITY} FROM ranked GROUP BY 1)
        SELECT *, CASE WHEN score >= 200 THEN 'CRITICAL' WHEN score >= 100 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' WHEN score >= 1 THEN 'LOW' ELSE 'CLEAN' END AS level FROM s""",
    "worst_findings": f"WITH {_sql()} SELECT doc_id, pattern, line, start, matched FROM ranked ORDER BY r DESC, weight DESC, doc_id, pattern, start LIMIT 20",
}
