import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from stratalog.llm import quality, rules, substring, topk

from tests.llm.fixtures import documents, frame, words


def brute_top(rows, k):
    live = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(live):
        if q % 5 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for n, (i, b) in enumerate(live) if n != at)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def vectors(rng):
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(230)]
    rows += [(300 + i, [0.5] * 6) for i in range(60)]  # ties
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [1.0] * 6), (405, []), (410, [0.25, 1.0]), (415, rows[3][1])]
    return rows + [(415, rows[3][1])]


def test_top_k_as_brute_force(spark):
    rows = vectors(random.Random(2))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS v", "3 AS shard").repartition(3)
    params = topk.TopKParams(k=7, shard_rows=50, block_rows=8, leaf_rows=4)
    got = topk.top_inner_products(df, F.col("vec_id") % 5 == 0, params=params)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 7)


def test_regions_and_boxes_save_visits():
    """Points in tight clusters: a query sees the leaves of few of them, and a floor saves more."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-1000, 1000, (16, 5))
    points = np.repeat(centres, 64, axis=0) + rng.integers(-5, 6, (1024, 5))
    dims, values = topk.region_tree(points[::3], 3)
    regions = topk.regions_of(points, dims, values)
    assert set(regions) <= set(range(8)) and len(set(regions)) > 4
    tree = topk.build_tree(np.arange(1024), np.arange(1024), points, 32)
    search = topk.Search(np.arange(0, 1024, 100), points[::100], 5)
    search.visit(tree)
    for i, (scores, _) in enumerate(search.best):
        column = np.sort(np.delete(points @ points[100 * i], 100 * i))[::-1][:5]
        assert scores.tolist() == column.tolist()
    assert search.visited < 0.5 * search.leaves
    again = topk.Search(np.arange(0, 1024, 100), points[::100], 5, np.array([s[-1] for s, _ in search.best]))
    again.visit(tree)
    assert again.visited <= search.visited and [s.tolist() for s, _ in again.best] == [s.tolist() for s, _ in search.best]


def test_top_k_of_few_and_of_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.25, 1.0])], schema)
    assert [tuple(r) for r in topk.top_inner_products(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 64 * 16 + 32 * 64)]
    assert topk.top_inner_products(few.limit(0), F.col("vec_id") == 0).collect() == []


def test_products_beyond_float_precision(spark):
    big = spark.createDataFrame([(0, [2.0**26, 1.0]), (1, [2.0**20, 1 / 64]), (2, [2.0**20, 2 / 64])], "vec_id long, embedding array<double>")
    got = [tuple(r)[1:] for r in topk.top_inner_products(big, F.col("vec_id") == 0).collect()]
    assert got == [(1, 2, 2**58 + 128), (2, 1, 2**58 + 64)]


def labelled(rng):
    good = [(i, words(rng, rng.randint(20, 60)), "en", "s", 1) for i in range(200)]
    bad = [(1000 + i, " ".join(w + rng.choice(["###", "$$$", "!!"]) for w in words(rng, rng.randint(20, 60)).split()), "en", "s", 1) for i in range(60)]
    return good + bad


def test_quality_on_held_out_rows(spark):
    rng = random.Random(5)
    rows = labelled(rng)
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in rows] + [(None, 1, 0), (5, None, 0), (7, 3, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels.where(~quality.is_held_out()), params=quality.QualityParams(max_rows=150))
    got = quality.score_quality(docs.withColumn("held", quality.is_held_out()), model).collect()
    held = [r for r in got if r.held]
    assert {r.doc_id for r in held} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0}
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == int(r.doc_id < 1000) for r in held) >= 0.95 * len(held)
    again = quality.fit_quality(docs.repartition(5), labels.where(~quality.is_held_out()), params=quality.QualityParams(max_rows=150))
    assert np.array_equal(model.weights, again.weights)


def test_quality_of_awkward_rows(spark):
    docs = frame(spark, extra=True)
    labels = spark.createDataFrame([(1, 1), (2, 1), (4006, 1)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs, model)
    assert got.count() == len(documents())
    assert {round(r.score, 6) for r in got.collect()} == {round(5 / 6, 6)}  # one class: (4 + 1) / (4 + 2)
    assert quality.score_quality(docs.limit(0), quality.fit_quality(docs.limit(0), labels.limit(0))).collect() == []


def test_log_count_ratios_and_hinge():
    rows = [np.array(r, np.int32) for r in ([0, 1], [0, 2], [3], [3, 2])]
    y = np.array([1, 1, 0, 0])
    ratios = quality.log_count_ratios(rows, y, 4, 1.0)
    assert np.allclose(ratios[0], math.log((3 / 8) / (1 / 7)))
    weights = quality.fit_hinge(rows, ratios, y, np.full(4, 10.0), 50, 1)
    assert [quality.margin(r, ratios, weights) > 0 for r in rows] == [True, True, False, False]


def brute_measures(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= set(range(i, i + 5))
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered)


def test_rules_as_brute_force(spark):
    rng = random.Random(9)
    lines = [words(rng, 6) for _ in range(4)]
    rows = documents() + [(6000 + i, "\n".join(rng.choice([*lines, "", "  ", words(rng, 3)]) for _ in range(12)), "en", None, 1) for i in range(40)]
    rows.append((7000, "a# b$\r\na# b$\r\nx|<>\n\n \n&*% a# b$", "en", "s", 1))
    got = rules.judge_documents(frame(spark, rows, extra=True)).collect()
    want = Counter((r[0], *brute_measures(r[1])) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert rules.judge_documents(frame(spark, [])).collect() == []


def test_common_lines_of_a_host_deplete_its_documents(spark):
    rng = random.Random(4)
    banner = words(rng, 30)
    rows = [(i, f"{banner}\n{words(rng, 5)}", "en", "a", 1) for i in range(30)]  # banner on every page: little is left
    rows += [(100 + i, f"{banner.upper()}\n{words(rng, 90)}", "en", "a", 1) for i in range(5)]  # most is left
    rows += [(200 + i, f"{banner}\n{words(rng, 5)}", "en", "b", 1) for i in range(10)]  # too few documents of this host
    copy = f"{words(rng, 40)}\n{words(rng, 20)}"
    rows += [(300 + i, copy, "en", "c", 1) for i in range(50)]  # copies of one text: its lines aren't common
    params = rules.RuleParams(min_line_docs=20, of_texts=True)
    got = {r.doc_id: r for r in rules.judge_documents(frame(spark, rows), params=params).collect()}
    assert {got[i].kept for i in range(30)} == {False} and {got[i].removed_words for i in range(30)} == {30}
    assert all(got[i].kept for i in (*range(100, 105), *range(200, 210), *range(300, 350)))


def test_cleaned_documents_as_brute_force(spark):
    """Lines in more than five documents of a host, and in more than a fiftieth of them, go; the rest stays as it was."""
    rng = random.Random(5)
    common = [words(rng, 8) for _ in range(3)]
    rows = []
    for i in range(60):
        own = [words(rng, rng.randint(6, 12)) for _ in range(rng.randint(1, 4))]
        host = rng.choice(["a", "b", None])
        rows.append((i, "\n".join([rng.choice(common), *own, "", "  " + rng.choice(common).upper() + " \t"]), "en", host, 1))
    rows += [(100, None, "en", "a", 1), (101, "", "en", "b", 1), (None, common[0], "en", "a", 1), (5, rows[5][1], "en", rows[5][3], 1)]
    holders, hosts = {}, {}
    for i, text, _, host, _ in rows:
        hosts.setdefault(host, set()).add(i)
        for line in (text or "").split("\n"):
            if line.split():
                holders.setdefault((host, " ".join(line.lower().split())), set()).add(i)
    gone = {k for k, v in holders.items() if len(v) > 5 and len(v) > 0.02 * len(hosts[k[0]])}
    assert gone
    want = Counter()
    for i, text, lang, host, n in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if (host, " ".join(x.lower().split())) not in gone]
        total, kept = len((text or "").split()), sum(len(x.split()) for x in left)
        if total >= 10 and 100 * brute_measures(text)[4] <= 20 * total and 100 * kept >= 30 * total:
            want[(i, "\n".join(left), lang, host, n)] += 1
    got = rules.clean_documents(frame(spark, rows, extra=True))
    assert got.columns == frame(spark, rows, extra=True).columns
    assert Counter(tuple(r)[:5] for r in got.collect()) == want
    judged = rules.judge_documents(frame(spark, rows)).collect()
    assert sum(r.removed_words for r in judged) > 0 and Counter(r.doc_id for r in judged if r.kept) == Counter(w[0] for w in want.elements())
    assert rules.clean_documents(frame(spark, [])).collect() == []


def test_gear_hash_depends_on_near_bytes_only():
    table = substring.gear_table(5)
    data = np.random.default_rng(1).integers(0, 256, 200).astype(np.uint8)
    h, want = substring.gear_hashes(data, table), 0
    for byte, got in zip(data, h, strict=True):
        want = ((want << 1) + int(table[byte])) & 0xFFFFFFFF
        assert int(got) == want


def test_chunks_survive_insertions():
    rng = random.Random(8)
    table = substring.gear_table(5)
    own = words(rng, 300).encode().split()
    cut = substring.cut_chunks(own, table, 24).tolist()
    moved = substring.cut_chunks([b"inserted", b"here", *own], table, 24).tolist()
    assert set(moved[3:]) >= {c + 2 for c in cut[4:]}


def test_repeated_passages_go_and_the_rest_stays(spark):
    rng = random.Random(6)
    passages = [words(rng, 60) for _ in range(5)]
    rows = []
    for i in range(60):
        own = [words(rng, 50), words(rng, 50)]
        rows.append((i, "\n".join([own[0], passages[i % 5], own[1]]) if i % 2 else " ".join(own), "en", "s", 1))
    docs = frame(spark, rows, extra=True)
    out = substring.drop_repeated_passages(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == 60
    first = {}
    for i, text, *_ in rows:
        if i % 2 == 0:
            assert got[i].text == text and got[i].removed_words == 0
            continue
        p = passages[i % 5]
        if first.setdefault(i % 5, i) == i:
            assert got[i].text == text
        else:
            assert got[i].removed_words >= 30 and got[i].first_docs == [first[i % 5]] and p not in got[i].text
            left = text
            for s in reversed(got[i].spans):
                left = left[: s["start"]] + (left[s["end"] :] if s["end"] >= 0 else "")
            assert got[i].text == left
            kept = set(got[i].text.split())
            assert kept >= set(text.split("\n")[0].split()) and kept >= set(text.split("\n")[2].split())


def test_passages_of_awkward_rows(spark):
    docs = frame(spark)
    got = substring.drop_repeated_passages(docs).collect()
    assert len(got) == len(documents())
    texts = {(r[0], r[1]) for r in documents()}
    for r in got:
        if r.removed_words == 0:
            assert (r.doc_id, r.text) in texts
    copies = [r for r in got if r.doc_id is not None and 2000 <= r.doc_id < 2008]
    assert sorted(r.doc_id for r in copies if r.text == "") == list(range(2000, 2008))  # the near copies before them have all of it
    assert {r.doc_id for r in got if r.doc_id == 4006 and r.removed_words == 0} == {4006}
    assert substring.drop_repeated_passages(frame(spark, [])).collect() == []


def test_top_k_with_clashing_names(spark):
    """Columns named like those used inside come to no harm."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 6)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    params = topk.TopKParams(k=4, shard_rows=20, block_rows=8, leaf_rows=4, cell_trees=2)
    want = sorted(map(tuple, topk.top_inner_products(df, F.col("vec_id") % 5 == 0, params=params).collect()))
    for name in ("id", "v", "q", "row", "shard", "part", "block", "of", "tree", "tree_id", "bound", "score", "rank", "place", "within"):
        df = df.withColumn(name, F.lit("mine"))
    assert sorted(map(tuple, topk.top_inner_products(df, F.col("vec_id") % 5 == 0, params=params).collect())) == want


def test_passages_are_found(spark):
    """Of the windows of thirty words that an earlier document has, nearly all go."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]

    def windows(rows):
        seen, repeated = set(), 0
        for _, text in sorted(rows):
            w = (text or "").lower().split()
            own = {" ".join(w[i : i + 30]) for i in range(len(w) - 29)}
            repeated += len(own & seen)
            seen |= own
        return repeated

    df = spark.createDataFrame(docs, "doc_id long, text string")
    cut = [(r.doc_id, r.text) for r in substring.drop_repeated_passages(df).select("doc_id", "text").collect()]
    before, after = windows(docs), windows(cut)
    assert before > 500 and after <= 0.03 * before
