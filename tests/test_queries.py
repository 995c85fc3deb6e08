"""Every query with a SQL twin gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest
from stratalog.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_as_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF_DIR)
    want = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_all_but_the_tokenizer_have_sql():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"canonical_groups"}


def test_canonical_groups_as_brute_force(spark):
    from stratalog.functions.canonical import canonical_text

    groups = {}
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        groups.setdefault(canonical_text(r.text), []).append((r.doc_id, r.text))
    want = sorted((min(i for i, _ in g), len(g), len({t for _, t in g})) for g in groups.values() if len(g) > 1)
    assert sorted(map(tuple, registry.QUERIES["canonical_groups"](spark, SF_DIR).collect())) == want
