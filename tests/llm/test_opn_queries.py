"""The registered queries as they stand: against DuckDB where SQL has them, else against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from stratalog.llm import packing, quality, queries, substring
from stratalog.llm.common import running, scratch, shared_dir, written
from stratalog.llm.url_seeds import labelled_urls

from tests.llm.fixtures import documents, frame
from tests.llm.test_urls_shards_chat import brute_rule
from tests.test_queries import SF_DIR, TABLES, rows


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_as_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF_DIR)
    want = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_rules_remove_lines_on_the_tables(spark):
    """The line rule fires; were it the base rules alone, the comparison with SQL would prove nothing."""
    got = queries.op9_quality_rules(spark, SF_DIR.replace("sf0.001", "sf0.01")).collect()
    assert sum(r.removed_words > 0 for r in got) > 20


def test_url_query(spark):
    """Host, path and rule of every page by plain Python; the method judges the rest, and rightly on names it hasn't seen."""
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    got = queries.op2_url_filter(spark, SF_DIR).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path, rule = brute_rule(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.host + rule.path)
        assert r.verdict == (rule.verdict if rule else r.verdict) and r.verdict in ("allow", "block")


def test_url_model_on_held_out_names(spark):
    from stratalog.llm import url_filter

    seeds = labelled_urls(spark)
    model = url_filter.fit_url_model(seeds.where("NOT held_out"))
    got = url_filter.judge_urls(seeds.where("held_out"), (), model).collect()
    right = sum((r.verdict == "block") == (r.label == 1) for r in got)
    assert right >= 0.75 * len(got)  # half of the rows show their label in one part alone, and a name isn't known
    telling = [r for r in got if re.search(r"/(aff|buy-now|loan|pills|xxx|docs|wiki|research|recipes)/", r.path)]
    assert telling and sum((r.verdict == "block") == (r.label == 1) for r in telling) >= 0.9 * len(telling)


def test_shard_query(spark, docs):
    got = queries.op3_hilbert_shards(spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    slots = defaultdict(list)
    for r in got:
        data = (docs[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_mix_query(spark, docs):
    got = queries.op4_weighted_mix(spark, SF_DIR).collect()
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for i, d in docs.items()}
    assert {r.doc_id: r["size"] for r in got} == words
    target, taken = {}, Counter()
    for r in got:
        target[docs[r.doc_id].source] = r.target
        taken[docs[r.doc_id].source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    assert sum(taken.values()) == int(1.5 * sum(words.values()))
    for s, t in target.items():  # within a document of the source; where the budget ends, two
        largest = max(n for i, n in words.items() if docs[i].source == s)
        assert abs(taken[s] - t) <= 2 * largest
    assert sum(abs(taken[s] - t) > max(n for i, n in words.items() if docs[i].source == s) for s, t in target.items()) <= 1


def test_quality_query(spark, docs):
    """Scores as plain Python makes them from the same rows; labels of held-out rows change nothing."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.op6_quality_nbsvm(spark, SF_DIR).collect()}
    assert set(got) == set(docs)
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs}
    assert all(got[i].held_out == held[i] for i in docs)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    judged = [(got[i].predicted, labels[i]) for i in docs if held[i] and labels.get(i) is not None]
    assert sum(a == b for a, b in judged) >= 0.8 * len(judged)
    p = quality.QualityParams()
    known = [i for i in docs if not held[i] and labels.get(i) in (0, 1)]
    frame_ = spark.createDataFrame([(i, docs[i].text, labels[i]) for i in known], "doc_id long, text string, quality int")
    model = quality.fit_quality(frame_.drop("quality"), frame_.drop("text"))
    grams = quality.Grams(p)
    for i in list(docs)[::7]:
        m = quality.margin(grams((docs[i].text or "").encode()), model.scale, model.weights)
        assert math.isclose(got[i].score, 1 / (1 + math.exp(-(model.a * m + model.b))), rel_tol=1e-9, abs_tol=1e-12)


def brute_passages(rows):
    """(id, text) -> Counter of (id, text left, chunks that an earlier document has, words that went)."""
    p = substring.SubstringParams()
    table = substring.gear_table(p.seed)
    first, chunked = {}, []
    for i, text in rows:
        data = (text or "").encode()
        words = data.split()
        at = substring.cut_chunks(words, table, p.mean_bytes).tolist() if words else []
        ends = [*at[1:], len(words)] if words else []
        chunks = [b" ".join(words[a:b]) for a, b in zip(at, ends, strict=True)]
        chunked.append((i, text, at, ends, chunks))
        for c in chunks:
            if i is not None and (c not in first or i < first[c]):
                first[c] = i
    holders = Counter(c for _, _, _, _, chunks in chunked for c in set(chunks))
    out = Counter()
    for i, text, at, ends, chunks in chunked:
        known = {c: first[c] for c in chunks if holders[c] > 1 and c in first and (i is None or first[c] < i)}
        places = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        left, to, gone = "", 0, 0
        for a, b in substring.passages(chunks, [y - x for x, y in zip(at, ends, strict=True)], known, p.min_words):
            begin = 0 if a == 0 else places[at[a]]
            left += text[to:begin]
            to = len(text) if b == len(chunks) else places[at[b]]
            gone += sum(ends[k] - at[k] for k in range(a, b))
        out[(i, text if text is None else left + text[to:], sum(c in known for c in chunks), gone)] += 1
    return out


def test_passages_as_brute_force(spark, docs):
    got = queries.op10_substring_dedup(spark, SF_DIR).collect()
    assert Counter((r.doc_id, r.text, r.dup_chunks, r.removed_words) for r in got) == brute_passages([(d.doc_id, d.text) for d in docs.values()])
    awkward = substring.drop_repeated_passages(frame(spark, extra=True)).collect()
    assert Counter((r.doc_id, r.text, r.dup_chunks, r.removed_words) for r in awkward) == brute_passages([(r[0], r[1]) for r in documents()])


def test_packing_query(spark, docs):
    got = queries.op7_best_two_fit(spark, SF_DIR).collect()
    assert {r.doc_id for r in got} == set(docs)
    parts = defaultdict(list)
    for r in got:
        parts[r.sequence_id].append((r.offset, r.length))
    for x in parts.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(parts) <= 1.02 * -(-sum(r.length for r in got) // 2048) + 1


def test_packing_keeps_clashing_columns(spark):
    rows = [(i, 0, 5 + i % 7, i * 3, "c", 1, 2, 3) for i in range(40)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long, before long, cell string, rank int, row int, part int")
    got = packing.pack(pieces.withColumn("sequence_id", F.lit("old")), capacity=20)
    assert Counter(tuple(r)[:8] for r in got.collect()) == Counter(rows)
    assert got.columns == [*pieces.columns, "sequence_id", "offset"]


def test_swap_takes_the_best_pair_that_there_is():
    """Sums that lengths alone would allow aren't there, as the bin holds these pieces itself; a smaller sum is taken."""
    counts = np.zeros(101, np.int64)
    counts[60] = 1
    counts[[30, 20, 19, 18, 17, 16, 15, 14, 13, 12, 11]] = 1
    left = counts.copy()
    uses = {60: 1, 30: 1}
    x, y = packing._two_for(30, 40, left, uses, np.arange(101))
    free = [s for s in range(1, 101) if left[s] - uses.get(s, 0) > 0 and s != 30]
    want = max(a + b for n, a in enumerate(free) for b in free[:n] if a + b <= 40)
    assert x + y == want and x != y


def test_running_sums_over_ties_and_nothing(spark):
    data = [(i % 3, i % 50, i) for i in range(500)]
    got = sorted((r["rank"], r.a, r.b, r.c, r.c_before) for r in running(spark.createDataFrame(data, "a int, b int, c long"), ["a", "b", "c"], ["c"]).collect())
    total = 0
    for n, (row, want) in enumerate(zip(got, sorted(data), strict=True)):
        assert row == (n, *want, total)
        total += want[2]
    assert running(spark.createDataFrame([], "a int, c long"), ["a"], ["c"]).collect() == []


def test_scratch_forgets_what_is_written(spark, tmp_path):
    import os

    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with scratch():
        kept = written(spark.range(3), "kept", keep=True)
        gone = written(spark.range(4), "gone")
        assert gone.count() == 4
    after = set(os.listdir(folder)) - before
    assert len([x for x in after if x.startswith("kept-")]) == 1 and not [x for x in after if x.startswith("gone-")]
    assert kept.count() == 3


def test_digests_of_the_hostile_conversation(spark):
    got = {r.conv_id: r for r in queries.op8_chat_format(spark, SF_DIR).collect()}[-1]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    text = queries.HOSTILE_TEXT
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (2, len(text), digest(text))
    assert got.turns_sha256 == digest(f"user\n{text}\nassistant\n{text}\n")
