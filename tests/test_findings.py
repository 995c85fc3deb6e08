"""The multi-pattern scan: cases of scans of source text, limits, and marks that lose nothing."""

import re

import pytest
from pyspark.sql import functions as F
from stratalog.operators import findings
from stratalog.operators.findings import Rule
from stratalog.plans import finding_queries

EVAL = Rule("obf-eval", "obfuscation", "HIGH", 25, (r"\beval\s*\(", r"new\s+Function\s*\("), ("eval", "function"))
PROTOTYPE = Rule("proto", "supply_chain", "CRITICAL", 40, (r"__proto__",), ("__proto__",))
SOCKET = Rule("socket", "network", "HIGH", 30, (r"new\s+net\.Socket", r"child_process"), ())
HOOK = Rule("hook", "supply_chain", "MEDIUM", 15, (r'"(?:post|pre)install"\s*:\s*"',), ('install"',))
BROKEN = Rule("broken", "evasion", "INFO", 1, ("[never closed",), ())
SCRIPT = Rule("script", "execution", "LOW", 3, ("exec",), (), ("js",))
RULES = (EVAL, PROTOTYPE, SOCKET, HOOK, BROKEN, SCRIPT)


def scanned(spark, texts, rules=RULES, language=None):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("lang", F.lit(language).cast("string"))
    return findings.scan(rows, "id", "text", rules, F.col("lang")).orderBy("id", "start").collect()


def test_cases(spark):
    shell = "const cp = require('child_process');\nconst s = new net.Socket();\ns.connect(4444);"
    package = '{\n  "name": "evil-package",\n  "scripts": {\n    "postinstall": "node setup.js"\n  }\n}'
    clean = "\nfunction add(a, b) {\n  return a + b;\n}\nconsole.log(add(1, 2));\n"
    got = scanned(spark, ['var x = eval("alert(1)");', shell, "obj.__proto__.isAdmin = true;", package, clean, None, "", "a [never closed b"])
    assert [(r.id, r.pattern, r.line) for r in got] == [(0, "obf-eval", 1), (1, "socket", 1), (1, "socket", 2), (2, "proto", 1), (3, "hook", 4), (7, "broken", 1)]
    assert got[0].matched == "eval(" and got[0].evidence == 'var x = eval("alert(1)");' and (got[0].start, got[0].end) == (8, 13)


def test_once_a_line_and_limits(spark):
    many = "\n".join(f"eval({i}); eval({i})" for i in range(80))
    got = scanned(spark, [many, "eval(1) new Function(2)", "x" * 100 + "\r\neval(" + "y" * 100])
    first = [r for r in got if r.id == 0]
    assert [r.line for r in first] == list(range(1, 26))  # fifty matches, two a line
    assert len([r for r in got if r.id == 1]) == 1
    last = got[-1]
    assert last.line == 2 and last.evidence == "x" * 58 + "↵" + "eval(" + "y" * 60 and last.start == 102
    long_rule = (Rule("long", "network", "LOW", 1, ("a+",)),)
    assert scanned(spark, ["a" * 300], long_rule)[0].matched == "a" * 120 + "..."


def test_dense_literal(spark):
    text = 'x\nvar payload = "Kj7xR2mN9pQ4sT6vW8yA1bC3dE5fG7hI0jL2kM4nO6qS8tU0wX2zA1bC3dE5fG7hI0jKj7xR2mN9pQ4sT6vW8yA1bC3dE5f";'
    got = scanned(spark, [text, '"' + "ab" * 60 + '"'], ())
    assert [(r.pattern, r.line, r.start, len(r.matched), len(r.evidence)) for r in got] == [("dense-literal", 2, 17, 63, 83)]


def test_languages(spark):
    assert scanned(spark, ["exec"], (SCRIPT,), "js") and not scanned(spark, ["exec"], (SCRIPT,), "py") and not scanned(spark, ["exec"], (SCRIPT,))


def test_marks_lose_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    unmarked = [Rule(r.pattern, r.category, r.severity, r.weight, r.expressions) for r in finding_queries.RULES]
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(findings.scan(docs, "doc_id", "text", finding_queries.RULES)) == order(findings.scan(docs, "doc_id", "text", unmarked))


def test_automaton_says_what_can_match():
    scanner = findings.Scanner(RULES)
    names = lambda text: [RULES[i].pattern for i in scanner.possible(text)]
    assert names("nothing") == ["socket", "broken", "script"]
    assert names("EVAL and __PROTO__") == ["obf-eval", "proto", "socket", "broken", "script"]


def test_scores(spark):
    rows = [(1, "a", "network", "HIGH", 30), (1, "b", "network", "LOW", 80), (1, "c", "crypto", "CRITICAL", 90), (2, "d", "crypto", "INFO", 0)]
    df = spark.createDataFrame(rows, "id long, pattern string, category string, severity string, weight int")
    assert sorted(map(tuple, findings.by_category(df, "id").collect())) == [(1, "crypto", 1, 90, "CRITICAL"), (1, "network", 2, 110, "HIGH"), (2, "crypto", 1, 0, "INFO")]
    assert sorted(map(tuple, findings.threat(df, "id").collect())) == [(1, 3, 200, "CRITICAL", "CRITICAL"), (2, 1, 0, "CLEAN", "INFO")]
    top = findings.top_findings(df.withColumn("start", F.lit(0)), "id", 2).collect()
    assert [r.pattern for r in top] == ["c", "a"]


@pytest.mark.parametrize("score", [0, 1, 39, 40, 99, 100, 199, 200])
def test_levels(spark, score):
    df = spark.createDataFrame([(1, "p", "network", "LOW", score)], "id long, pattern string, category string, severity string, weight int")
    want = "CLEAN" if score == 0 else "LOW" if score < 40 else "MEDIUM" if score < 100 else "HIGH" if score < 200 else "CRITICAL"
    assert findings.threat(df, "id").first().level == want


def test_rule_file(spark, tmp_path):
    (tmp_path / "rules.jsonl").write_text("\n".join(findings.rule_lines(RULES)))
    read = findings.read_rules(spark, f"file://{tmp_path}/rules.jsonl")
    assert sorted(read, key=lambda r: r.pattern) == sorted(RULES, key=lambda r: r.pattern)
