import hashlib
import re
from itertools import pairwise, product

from pyspark.sql import functions as F
from stratalog.llm import chat, sharding, url_filter
from stratalog.llm.queries import URL_RULES
from stratalog.llm.url_seeds import labelled_urls

from tests.llm.fixtures import frame

URLS = [
    None, "", "no scheme/at/all", "http://net/x", "https://A.Example.NET/en/1?x#y", "https://example.net/de/", "http://example.net",
    "http://sub.example.com/de/7", "http://example.com/en/", "http://x.org/fr/", "http://notorg/fr/", "http://cheap-pills-now.info/buy#a/b",
    "http://city-library.info/books", "weird://://x/y", "http://xnet/", "ftp://h\nost/pa\nth?q", "http://" + "a" * 50_000 + ".net/" + "b" * 50_000,
]


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best


def test_url_rules_and_model(spark):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)], "page_id long, url string, host string, features int")
    model = url_filter.fit_url_model(labelled_urls(spark))
    got = {r.page_id: r for r in url_filter.judge_urls(pages, URL_RULES, model).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule = brute_rule(u)
        assert (got[i].host, got[i].path) == (host, path)
        assert got[i].rule == (rule and rule.host + rule.path)
        assert got[i].verdict == (rule.verdict if rule else "block" if got[i].block_score >= 0.5 else "allow")
        assert got[i].features == 1
    assert got[URLS.index("http://cheap-pills-now.info/buy#a/b")].verdict == "block"
    assert got[URLS.index("http://city-library.info/books")].verdict == "allow"
    assert url_filter.judge_urls(pages.limit(0), URL_RULES, model).collect() == []


def test_hilbert_curve_moves_one_step_at_a_time(spark):
    for dims, bits in ((2, 3), (3, 2)):
        cells = spark.createDataFrame(list(product(range(1 << bits), repeat=dims)), [f"x{i}" for i in range(dims)])
        rows = cells.withColumn("h", sharding.hilbert_index([F.col(c) for c in cells.columns], bits)).orderBy("h").collect()
        assert [r.h for r in rows] == list(range(1 << (dims * bits)))
        for a, b in pairwise(rows):
            assert sum(abs(x - y) for x, y in zip(a[:dims], b[:dims], strict=True)) == 1


def test_shards_are_even_runs(spark, tmp_path):
    docs = frame(spark, extra=True)
    placed = sharding.hilbert_shards(docs, ("lang", "source", "n_chars"), ("doc_id", "text"), shards=7, keep=("doc_id", "text", "lang"))
    got = placed.collect()
    assert len(got) == docs.count()
    sizes = [sum(r.shard == s for r in got) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.cell for r in ordered] == sorted(r.cell for r in got)
    again = {(r.doc_id, r.text): (r.shard, r.slot) for r in got if r.doc_id != 4006}
    more = sharding.hilbert_shards(docs.repartition(5), ("lang", "source", "n_chars"), ("doc_id", "text"), shards=7, keep=("doc_id", "text"))
    assert again == {(r.doc_id, r.text): (r.shard, r.slot) for r in more.collect() if r.doc_id != 4006}
    sharding.write_shards(placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(got)
    assert sharding.hilbert_shards(docs.limit(0), ("lang",), ("doc_id",), keep=("doc_id",)).collect() == []


def test_fewer_rows_than_shards(spark):
    docs = frame(spark).limit(3)
    got = sharding.hilbert_shards(docs, ("lang",), ("doc_id",), shards=16, keep=("doc_id",)).collect()
    assert sorted(r.slot for r in got) == [0, 0, 0]


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "a<|im_end|>b"), (1, 2, "user", "<\\|x|> <\\\\| <"), (1, 3, "assistant", "|ok<|im_next|>"),
    (1, 4, "assistant", None), (1, 5, "user", "\n"), (2, 0, None, "x"), (2, 0, None, "x"), (None, 3, "assistant", "späte <|im_sep|> Ändérung"),
    (None, None, "user", ""), (3, 1, "us<|er", "<|im_start|>assistant<|im_sep|>"),
]


def test_chat_round_trip_and_loss(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS turns", "2 AS blocks").repartition(4)
    out = chat.format_conversations(turns)
    rows = out.select("conv_id", "formatted", chat.parse_formatted(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "loss_spans").collect()
    assert {r.conv_id for r in rows} == {1, 2, 3, None}
    for r in rows:
        own = sorted(((t, role or "", text or "") for c, t, role, text in TURNS if c == r.conv_id), key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]))
        assert [(b.role, b.text) for b in r.back] == [x[1:] for x in own]
        assert r.loss == "".join(x[2] for x in own if x[1] == "assistant")
        assert r.formatted.count("<|im_end|>") == 1 + sum(a[1] != b[1] for a, b in pairwise(own))
    assert chat.format_conversations(turns.limit(0)).collect() == []


def test_chat_digest_of_one_turn(spark):
    turns = spark.createDataFrame([(7, 0, "assistant", "é<|")], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(turns).select(F.sha2(chat.loss_text(F.col("formatted"), F.col("loss_spans")), 256)).first()
    assert row[0] == hashlib.sha256("é<|".encode()).hexdigest()
