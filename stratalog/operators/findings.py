"""Findings of many patterns in one pass over each text: line, offset, matched text and context; scores by category."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import score as S

#: From the mildest to the worst.
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
# Limits of a scan.
MATCHES, CONTEXT, LONGEST_MATCH = 50, 60, 120
DENSE_LITERAL, DENSE_A_LINE, DENSE_LENGTH, DENSE_BITS = r"""["'`]([A-Za-z0-9+/=_-]{60,})["'`]""", 5, 80, 5.0
#: A rule file is read up to this number of rules.
MOST_RULES = 5000

_COLUMNS = "pattern string, category string, severity string, weight int, line int, start long, end long, matched string, evidence string"


@dataclass(frozen=True)
class Rule:
    """Regular expressions of one pattern; ``marks``: every match of any of them has one of these strings, in lower case.

    Without marks the expressions run over every text. Names of languages limit a rule to texts of these; none means all.
    """

    pattern: str
    category: str
    severity: str
    weight: int
    expressions: tuple[str, ...]
    marks: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rules from JSON lines: id, category, severity, weight, patterns, and marks and languages where given."""
    kind = "id string, category string, severity string, weight int, patterns array<string>, marks array<string>, languages array<string>"
    rows = spark.read.schema(kind).json(path).orderBy("id").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return [Rule(r.id, r.category, r.severity, r.weight, tuple(r.patterns or ()), tuple(r.marks or ()), tuple(r.languages or ())) for r in rows]


def _compiled(expression: str) -> re.Pattern[str]:
    """An expression that doesn't compile is looked for as it stands."""
    try:
        return re.compile(expression, re.ASCII)
    except re.error:
        return re.compile(re.escape(expression))


class Scanner:
    """All rules; an automaton over the marks says in one pass over a text which expressions can match at all."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        import ahocorasick

        self.rules = [(r, [_compiled(e) for e in r.expressions]) for r in rules]
        self.automaton = ahocorasick.Automaton()
        marked: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            for mark in r.marks:
                marked.setdefault(mark.lower(), []).append(i)
        for mark, of in marked.items():
            self.automaton.add_word(mark, tuple(of))
        if marked:
            self.automaton.make_automaton()
        self.always = {i for i, r in enumerate(rules) if not r.marks}
        self.dense = re.compile(DENSE_LITERAL)

    def possible(self, text: str) -> list[int]:
        found = set(self.always)
        if len(self.automaton):
            for _, of in self.automaton.iter(text.lower()):
                found.update(of)
        return sorted(found)

    def __call__(self, text: str, language: str | None = None) -> Iterator[tuple]:
        ends = [m.start() for m in re.finditer("\n", text)]
        line = lambda at: bisect_left(ends, at) + 1
        for i in self.possible(text):
            rule, expressions = self.rules[i]
            if rule.languages and language not in rule.languages:
                continue
            seen: set[int] = set()
            for expression in expressions:
                for _, m in zip(range(MATCHES), expression.finditer(text), strict=False):
                    at = line(m.start())
                    if at not in seen:
                        seen.add(at)
                        shown = m[0] if len(m[0]) <= LONGEST_MATCH else m[0][:LONGEST_MATCH] + "..."
                        yield rule.pattern, rule.category, rule.severity, rule.weight, at, m.start(), m.end(), shown, _context(text, m.start(), m.end())
        begin = 0
        for number, part in enumerate(text.split("\n"), 1):
            for _, m in zip(range(DENSE_A_LINE), self.dense.finditer(part), strict=False):
                if len(m[1]) > DENSE_LENGTH and _bits(m[1]) > DENSE_BITS:
                    cut = lambda n, s=m[1]: s if len(s) <= n else s[:n] + "..."
                    yield "dense-literal", "obfuscation", "HIGH", 20, number, begin + m.start(1), begin + m.end(1), cut(60), cut(80)
            begin += len(part) + 1


def _context(text: str, start: int, end: int) -> str:
    return text[max(start - CONTEXT, 0) : end + CONTEXT].replace("\n", "↵").replace("\r", "")


def _bits(text: str) -> float:
    import numpy as np

    counts = np.unique(np.frombuffer(text.encode("utf-32-le"), "<u4"), return_counts=True)[1] / len(text)
    return float(-(counts * np.log2(counts)).sum())


def scan(rows: DataFrame, id_col: str, text: str, rules: Sequence[Rule], language: Column | None = None) -> DataFrame:
    """A row for each finding: id, pattern, category, severity, weight, line (from 1), start and end (characters from 0),
    matched text and context.

    A pattern counts once a line, and of each expression the first MATCHES matches are looked at. Literals in quotes of more than
    DENSE_LENGTH characters and DENSE_BITS bits a character are findings too. Null texts have none. Rows with equal ids
    are scanned each. Texts are scanned where they are read, and only findings leave the worker.
    """
    given = rows.select(F.col(id_col), F.col(text), (F.lit(None).cast("string") if language is None else language).alias("language"))
    kind = dict(given.dtypes)[id_col]
    rules = tuple(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            ids, out = [], []
            for i in range(batch.num_rows):
                body = batch.column(1)[i].as_py()
                for finding in scanner(body, batch.column(2)[i].as_py()) if body else ():
                    ids.append(i)
                    out.append(finding)
            columns = [pa.array([f[k] for f in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *columns], names=[id_col, "pattern", "category", "severity", "weight", "line", "start", "end", "matched", "evidence"])

    return given.mapInArrow(run, f"`{id_col}` {kind}, {_COLUMNS}")


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity), F.lit(0)).cast("int")


def severity_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), rank - 1)


def by_category(findings: DataFrame, *group: str) -> DataFrame:
    """Count, score (sum of weights) and worst severity of each category, per group."""
    per = findings.groupBy(*group, "category").agg(F.count("*").alias("count"), F.sum("weight").alias("score"), F.max(severity_rank(F.col("severity"))).alias("r"))
    return per.select(*group, "category", "count", "score", severity_name(F.col("r")).alias("max_severity"))


def threat(findings: DataFrame, *group: str) -> DataFrame:
    """Findings, score over all categories, its level and the worst severity, per group."""
    per = findings.groupBy(*group).agg(F.count("*").alias("findings"), F.sum("weight").alias("score"), F.max(severity_rank(F.col("severity"))).alias("r"))
    return per.select(*group, "findings", "score", S.threat_level(F.col("score")).alias("level"), severity_name(F.col("r")).alias("max_severity"))


def top_findings(findings: DataFrame, id_col: str, limit: int = 20) -> DataFrame:
    """The worst findings of all: by severity, then weight, then id, pattern and place."""
    return findings.orderBy(severity_rank(F.col("severity")).desc(), F.desc("weight"), id_col, "pattern", "start").limit(limit)


def rule_lines(rules: Sequence[Rule]) -> list[str]:
    """Rules as the JSON lines that ``read_rules`` takes."""
    return [json.dumps({"id": r.pattern, "category": r.category, "severity": r.severity, "weight": r.weight, "patterns": r.expressions, "marks": r.marks, "languages": r.languages}) for r in rules]
