"""Symbols of more languages, snippets, registries with overrides, score files and conditions."""

import json

import pytest
from pyspark.sql import functions as F
from stratalog.functions import canonical
from stratalog.functions import shapes as P
from stratalog.functions import text as X
from stratalog.sources import files

JAVA = """package com.example;

import java.util.List;
import static java.util.Collections.emptyList;

public class Greeter {
    public String hello(String name) {
        return "Hi " + name;
    }
    private static int helper() { return 0; }
}

interface Drivable {
    void drive();
}

enum Color { RED, GREEN }
"""
ZIG = """const std = @import("std");
const c = @cImport({});

pub fn add(a: i32, b: i32) i32 {
    return a + b;
}

fn helper() void {}

pub const Point = struct {
    x: i32,
};

const Color = enum { red, green };
"""
C = """#include <stdio.h>
#include "own.h"
#define MAX 10

typedef struct node { int x; } node_t;
enum color { RED };

static int add(int a, int b) {
    return a + b;
}
"""
CSHARP = """using System;
using static System.Math;

public sealed class Program {
    [Obsolete]
    public static void Main(string[] args) {
    }
    private async Task Run(int x) { }
}
internal record Point(int X);
"""
GO = """package main

import "fmt"
import (
\t"os"
\talias "path/filepath"
)

const A, B = 1, 2
const (
\tC = iota
\tD
)

var x int
var (
\ty, z = 1, 2
)

type T struct {
\tInner int
}

func Plain() {}
func (t *T) Method(a int) error {
\treturn nil
}
"""


@pytest.mark.parametrize(
    ("language", "body", "want"),
    [
        ("java", JAVA, {"classes": ["Greeter", "Drivable", "Color"], "functions": ["hello", "helper", "drive"], "imports": ["java.util.List", "java.util.Collections.emptyList"]}),
        ("zig", ZIG, {"functions": ["add", "helper"], "classes": ["Point", "Color"], "imports": ["std", "@cImport"]}),
        ("c", C, {"functions": ["add"], "classes": ["node", "color"], "consts": ["MAX"], "imports": ["stdio.h", "own.h"]}),
        ("csharp", CSHARP, {"functions": ["Main", "Run", "Point"], "classes": ["Program", "Point"], "imports": ["System", "System.Math"], "consts": []}),
        ("go", GO, {"functions": ["Plain", "Method"], "types": ["T"], "consts": ["A", "B", "C", "D"], "vars": ["x", "y", "z"], "imports": ["fmt", "os", "path/filepath"]}),
    ],
)
def test_symbols(spark, language, body, want):
    df = spark.createDataFrame([(body,)], "b string")
    row = df.select(*[P.symbols(F.col("b"), language, k).alias(k) for k in want]).first()
    assert {k: row[k] for k in want} == want


def test_two_hundred_names(spark):
    body = "\n".join(f"fn f{i}() void {{}}\nconst m{i} = @import(\"m{i}\");" for i in range(300))
    row = spark.createDataFrame([(body,)], "b string").select(P.symbols(F.col("b"), "zig", "functions").alias("f"), P.symbols(F.col("b"), "zig", "imports").alias("i")).first()
    assert row.f == [f"f{i}" for i in range(200)] and len(row.i) == 300


def plain_snippet(text, query):
    text = text or ""
    at = text.lower().find(query.lower())
    if at < 0:
        return text[:200]
    start = max(at - 100, 0)
    if start + 200 > len(text):
        start = max(len(text) - 200, 0)
    return text[start : start + 200].replace("\n", " ")


def test_snippet_around(spark):
    texts = [None, "", "short Match", "x" * 300, "a\n" * 90 + "MATCH" + "b\n" * 90, "match" + "c" * 400, "d" * 400 + "match", "é" * 150 + "maTch" + "\n" * 20]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in df.select(X.snippet_around(F.col("t"), "match").alias("s")).collect()] == [plain_snippet(t, "match") for t in texts]


def test_bypassed(spark):
    df = spark.createDataFrame([("x",), (None,)], "t string")
    assert [r.b for r in df.select(canonical.is_bypassed(F.col("t")).alias("b")).collect()] == [False, False]
    assert df.limit(1).select(canonical.is_bypassed(F.repeat("t", F.lit(canonical.LARGEST + 1))).alias("b")).first().b is True


def test_registry(spark, tmp_path):
    for folder, entries in (("base", {"a": {"v": 1}, "b": {"v": 2}}), ("own", {"b": {"v": 9}, "c": {"v": 3}})):
        (tmp_path / folder).mkdir()
        for name, doc in entries.items():
            (tmp_path / folder / f"{name}.json").write_text(json.dumps(doc))
    (tmp_path / "own" / "a.json").write_text("{broken")
    got = files.registry(spark, f"file://{tmp_path}/base", f"file://{tmp_path}/own")
    assert sorted((r.name, r.v, r.origin) for r in got.select("name", F.try_variant_get("tree", "$.v", "int").alias("v"), "origin").collect()) == [("a", 1, "embedded"), ("b", 9, "override"), ("c", 3, "override")]
    assert files.registry(spark, f"file://{tmp_path}/base").count() == 2


def test_sidecars(spark, tmp_path):
    (tmp_path / "one_score.json").write_text('{"package_id": "app1", "mean10": 858, "dims_at_80": 11}')
    (tmp_path / "app1-SCORECARD.md").write_text("mean 1.0%\n1/12")
    (tmp_path / "app2_score.json").write_text("broken")
    (tmp_path / "app2-SCORECARD.md").write_text("# Scores\nMean score: **60.4%**\nAt 80: 7/12\n")
    (tmp_path / "app3-SCORECARD.md").write_text("nothing")
    got = sorted(map(tuple, files.score_sidecars(spark, f"file://{tmp_path}").select("package_id", "mean10", "dims_at_80", "source").collect()))
    assert got == [("app1", 858, 11, "json"), ("app2", 604, 7, "markdown")]


def test_conditions(spark):
    rules = [(1, "file_exists:${ROOT}/app.asar"), (2, "dir_exists:${ROOT}/lib/"), (3, "file_exists:${ROOT}/none"), (4, "dir_exists:${ROOT}/app.asar"), (5, ""), (6, None), (7, "always"), (8, "file_exists:${ROOT}/lib"), (9, "dir_exists:/r")]
    paths = spark.createDataFrame([("/r/app.asar",), ("/r/lib/x.js",), ("/r/lib/x.js",)], "path string")
    got = files.conditions_met(spark.createDataFrame(rules, "id int, c string"), "c", {"ROOT": "/r"}, paths)
    assert sorted(r.id for r in got.collect()) == [1, 2, 5, 6, 7, 8, 9]


def test_display_names_and_lines(spark):
    names = [("teams_module_42", "TeamsChat", "TeamsChat"), ("teams_module_42", " x\n", "x"), ("teams_module_42", " ", "teams_module_42"), ("teams_module_42", None, "teams_module_42"), ("WAWebMsg", "Other", "WAWebMsg"), ("teams_module_42x", "y", "teams_module_42x"), ("0123456789", "y", "0123456789")]
    df = spark.createDataFrame(names, "n string, s string, want string")
    assert df.where(X.display_name(F.col("n"), F.col("s")) != F.col("want")).count() == 0
    lines = [("sum", "role", "a,b", "[role] sum {a,b}"), (" sum ", None, "", "sum"), (None, "r", "t", "[r]  {t}"), ("s", " ", " t ", "s {t}")]
    df = spark.createDataFrame(lines, "s string, r string, t string, want string")
    assert df.where(X.summary_line(F.col("s"), F.col("r"), F.col("t")) != F.col("want")).count() == 0
