from collections import Counter, defaultdict

import pytest
from stratalog.llm.components import connected_components
from stratalog.llm.near_dup import NearDupParams, keep_one_of_each, near_duplicate_classes

from tests.llm.fixtures import documents, frame


def shingles(text, k):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute_components(rows, k):
    """(id, text) -> smallest id reachable; every pair that shares a shingle is compared."""
    sets = {i: shingles(t, k) for i, t in rows}
    holders, common = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for ids in holders.values():
        common.update((a, b) for n, a in enumerate(ids) for b in ids[n + 1 :])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k", [4, 5])
def test_components_as_brute_force(spark, k):
    got = near_duplicate_classes(frame(spark, extra=True), params=NearDupParams(words=k)).collect()
    want = brute_components([(r[0], r[1]) for r in documents()], k)
    assert len(got) == len(documents())
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


def test_chain_is_one_component(spark):
    """Neighbours are linked, the ends are not: the class is what links reach."""
    words = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(words[6 * k : 6 * k + 120]), "en", "s", 1) for k in range(10)]
    got = {r.doc_id: r.component_id for r in near_duplicate_classes(frame(spark, rows)).collect()}
    assert set(got.values()) == {0}


def test_large_group_of_near_copies_and_one_apart(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*base, f"x{k}"]), "en", "s", 1) for k in range(300)]
    rows.append((900, " ".join([*base[:40], *[f"y{i}" for i in range(30)]]), "en", "s", 1))
    got = {r.doc_id: r.component_id for r in near_duplicate_classes(frame(spark, rows)).collect()}
    assert {got[k] for k in range(300)} == {0}
    assert got[900] == 900


def test_keeps_one_row_of_each_group(spark):
    rows = frame(spark, extra=True)
    kept = keep_one_of_each(rows)
    assert kept.columns == rows.columns
    ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
    want = {i for i, (_, c) in brute_components([(r[0], r[1]) for r in documents()], 5).items() if i == c}
    assert ids == Counter(want)


def test_empty_table(spark):
    empty = frame(spark, [])
    assert near_duplicate_classes(empty).collect() == []
    assert keep_one_of_each(empty).collect() == []


def test_connected_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(64)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(65), 0), 100: 100, 101: 100}
