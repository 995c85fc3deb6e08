"""The hash forest, fill-in-middle and the secret scan against plain Python, on the awkward rows of the fixtures."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from stratalog.llm import infill, merkle, queries, secret_scan
from stratalog.llm.secret_seeds import labelled_strings

from tests.llm.fixtures import DOC_SCHEMA, documents, frame, words
from tests.test_queries import SF_DIR


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(digests, fan):
    """All levels, from the leaves to the root."""
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + fan])) for i in range(0, len(last), fan)])
    return levels


def brute_proof(levels, at, fan):
    out = []
    for level in levels[:-1]:
        run = at // fan * fan
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + fan])))
        at //= fan
    return out


def key(value):
    return (value is not None, value if isinstance(value, int) else (value or "").encode())


@pytest.mark.parametrize(("fan", "plain"), [(8, 90), (2, 33), (3, 0)])
def test_manifest(spark, fan, plain):
    rows = documents(plain=plain)
    df = frame(spark, rows, extra=True).withColumn("and no more", F.lit(1)).withColumn("tree", F.lit("x")).withColumn("lo", F.lit(2))
    df = df.withColumn("leaf", merkle.field_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]))
    got = merkle.merkle_manifest(df, "leaf", "lang", ["doc_id"], keep=["doc_id", "lang", "and no more", "tree", "lo"], fan=fan).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, text, lang, source, n in rows:
        groups[lang].append((key(i), brute_leaf(i, source, lang, n, text)))
    names = sorted(groups, key=key)
    trees = {n: brute_tree([d for _, d in sorted(groups[n])], fan) for n in names}
    top = brute_tree([trees[n][-1][0] for n in names], fan)
    want = []
    for at, n in enumerate(names):
        above = brute_proof(top, at, fan)
        want += [(n, leaf, trees[n][-1][0], top[-1][0], brute_proof(trees[n], k, fan) + above) for k, leaf in enumerate(trees[n][0])]
    assert sorted(((r.lang, r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in got), key=str) == sorted(want, key=str)
    assert all((r["and no more"], r.tree, r.lo) == (1, "x", 2) for r in got)


def test_manifest_tells_what_changed(spark):
    df = frame(spark).withColumn("leaf", merkle.field_digest(F.col("doc_id"), F.col("text")))
    proved = merkle.merkle_manifest(df, "leaf", "lang", ["doc_id"], keep=["doc_id"])
    other = F.when(F.col("doc_id") % 2 == 0, merkle.field_digest(F.col("doc_id"), F.lit("other"))).otherwise(F.col("leaf"))
    for r in proved.select("doc_id", (merkle.fold(other, F.col("proof")) == F.col("root")).alias("same")).collect():
        assert r.same == (r.doc_id is None or r.doc_id % 2 == 1)


@pytest.mark.parametrize("rows", [[], [(5, "only one", "en", "a", 8)], [(5, None, None, None, None)]])
def test_manifest_of_few_rows(spark, rows):
    df = spark.createDataFrame(rows, DOC_SCHEMA).withColumn("leaf", merkle.field_digest(F.col("doc_id"), F.col("text")))
    got = merkle.merkle_manifest(df, "leaf", "lang", ["doc_id"], keep=["doc_id"]).collect()
    assert [(r.leaf, r.root, r.subroot, r.proof) for r in got] == [(x := brute_leaf(r[0], r[1]), x, x, []) for r in rows]


def test_manifest_joins_prune_by_bucket(spark):
    """No join of the plan lacks an equality: containment alone would meet all nodes of a tree."""
    df = frame(spark).withColumn("leaf", merkle.field_digest(F.col("doc_id"), F.col("text")))
    plan = merkle.merkle_manifest(df, "leaf", "lang", ["doc_id"], keep=["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


UNITS = re.compile("[A-Za-z]+|[^A-Za-z]")


def brute_form(doc_id, text):
    """n, form, prefix, middle, suffix."""
    text = text or ""
    units = UNITS.findall(text)
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    plain = not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90
    form = "plain" if plain else "spm" if h4 % 100 < 20 else "psm"
    return len(units), form, "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])


def test_infill(spark):
    rng = random.Random(4)
    pieces = ["a", "Zz", " ", "\n", "<", ">", "<P", "P>", "<S", "é", "\U0001f600", "1", "\x00", "{", "[", "@", "`", "middle"]
    rows = [(7000 + i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 90))), "en", "s", 0) for i in range(150)]
    rows += documents() + [(9000, "has <M> in it", "en", "s", 0), (9001, "<P>" * 9, "en", "s", 0), (9002, words(rng, 90_000), "en", "s", 0), (9003, "x" * 200_000, "en", "s", 0)]
    df = frame(spark, rows, extra=True).withColumn("form", F.lit("old")).withColumn("cut", F.lit("mine")).withColumn("and no more", F.lit(3)).withColumn("whole", F.lit(1))
    got = infill.fill_in_middle(df).withColumn("again", infill.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    forms = set()
    for r in got:
        n, form, p, m, s = brute_form(r.doc_id, r.text)
        out = {"plain": r.text or "", "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        sizes = (None, None) if form == "plain" else (len(p), len(m))
        assert (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output, r.again) == (n, form, *sizes, out, r.text or "")
        assert (r.cut, r["and no more"], r.whole) == ("mine", 3, 1)
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(frame(spark, [])).collect() == []


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1000])
def test_wavelet_ranks(bits, size):
    symbols = np.random.default_rng(size).integers(0, 1 << bits, size).astype(np.uint8)
    matrix = infill.WaveletMatrix(symbols, bits)
    at = np.arange(size + 1)
    for s in range(1 << bits):
        assert matrix.rank(s, at).tolist() == [int((symbols[:i] == s).sum()) for i in at]


BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def brute_base(text):
    return sorted((m.start(), k, m.end(), kind) for k, (kind, p, good) in enumerate(BASE) for m in p.finditer(text or "") if good(m))


def brute_ratio(text, model):
    last, out, size = 0, 0.0, len(secret_scan.ALPHABET) + 1
    for c in text:
        at = secret_scan.ALPHABET.index(c) + 1
        out, last = out + model.ratios[last * size + at], at
    return out


def brute_added(text, model):
    return [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text or "") if brute_ratio(m[0], model) >= model.cut]


@pytest.fixture(scope="module")
def model(spark):
    return secret_scan.fit_markov(labelled_strings(spark))


def secret_rows():
    rng = random.Random(9)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    dense = lambda n: "".join(rng.choice(secret_scan.ALPHABET[:-3]) for _ in range(n))
    texts = [
        f"token = \"{hexa(40)}\"", f"Password: {dense(12)} and PASSWD='short'", "secret = token: abcdefgh", "secret=api:abcdefg", "token=token=abcdefgh",
        f"apikey={hexa(24)} api_key : x", "AKIA" + "A1" * 8, "AKIA" + "A" * 15, "AKIAAKIA" + "B" * 12, "xAKIA" + "Z9" * 30, f"é\U0001f600 {hexa(23)} {hexa(24)}g{hexa(25)}",
        f"{dense(44)} plain words {dense(30)}", "getUserAccountNameFromRequestHeader", "/usr/local/share/documentation/index", "=" * 60, "4929123412341234",
        "Donaudampfschiffahrtsgesellschaft", f"tokens[\"{dense(20)}\"]", f"secret\"  =  '{dense(8)}' secret: {dense(8)}", "Koken = abcdefgh toKen = abcdefgh", "token\t=abcdefgh",
        " ".join(f"token={hexa(40)} {dense(33)}" for _ in range(700)),
    ]
    parts = ["token", "secret", "=", ":", " ", "\"", "AKIA", "deadbeef", "0123456789", "x", "é", "api_key", "ABCDEF12", "\n", "zz-9"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return [(5000 + i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + documents()


def test_secrets(spark, model):
    rows = secret_rows()
    df = frame(spark, rows, extra=True).withColumn("base", F.lit(1)).withColumn("hex", F.lit(1)).withColumn("a.b", F.lit(1)).withColumn("and no more", F.lit(1))
    got = defaultdict(list)
    for r in secret_scan.scan_secrets(df, model).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    kinds = set()
    for i, text, *_ in rows:
        base, added = brute_base(text), brute_added(text, model)
        for r in got[i]:
            assert [(s.start, s.order, s.end, s.kind) for s in r.base] == base
            assert [(s.start, s.end) for s in r.added] == added
            assert all(s.text == text[s.start : s.end] for s in [*r.base, *r.added])
        kinds |= {s[3] for s in base} | ({"random"} if added else set())
    assert kinds == {"assign", "access", "hex", "random"}
    assert secret_scan.scan_secrets(frame(spark, []), model).collect() == []


def test_markov_counts(spark):
    """The ratios are those of plain counting; null, empty and other labels are left out."""
    samples = [("abab", 1), ("ab", 1), ("aa", 0), (None, 1), ("", 0), ("zz", 7), ("é", 0)]
    model = secret_scan.fit_markov(spark.createDataFrame(samples, "text string, label int"), smoothing=0.5)
    size = len(secret_scan.ALPHABET) + 1
    place = {c: i + 1 for i, c in enumerate(secret_scan.ALPHABET)}
    counts = np.full((2, size, size), 0.5)
    for text, label in (("abab", 1), ("ab", 1), ("aa", 0), ("é", 0)):
        last = 0
        for c in text:
            counts[label, last, place.get(c, 0)] += 1
            last = place.get(c, 0)
    chances = np.log(counts / counts.sum(axis=2, keepdims=True))
    assert np.allclose(model.ratios, (chances[1] - chances[0]).ravel())


def test_markov_on_held_out_strings(spark):
    seeds = labelled_strings(spark)
    model = secret_scan.fit_markov(seeds.where("NOT held_out"))
    rows = seeds.where(F.col("held_out") & (F.length("text") >= secret_scan.LEAST_RANDOM)).withColumn("ratio", secret_scan.log_likelihood_ratio(F.col("text"), model)).collect()
    for label, least in ((1, 0.99), (0, 0.999)):
        own = [r for r in rows if r.label == label]
        assert len(own) > 300 and sum((r.ratio >= model.cut) == (label == 1) for r in own) >= least * len(own)
        assert all(math.isclose(r.ratio, brute_ratio(r.text, model), rel_tol=1e-9, abs_tol=1e-9) for r in own[::40])


def test_secret_query(spark, model):
    """Every span of every document; the models flag each long hexadecimal string of the tables, and no word."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = queries.op13_secret_scan(spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        text = docs[r.doc_id] or ""
        base = brute_base(text)
        named = lambda spans: ",".join(f"{kind}:{a}:{e}" for a, _, e, kind in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[3] == k for s in base) for k, *_ in BASE)
        assert r.base_sha256 == sha(named(base))
        added = brute_added(text, model)
        assert r.spans == named(sorted([*base, *((a, 3, e, "random") for a, e in added)]))
        assert all(any(a <= s[0] and s[2] <= e for a, e in added) for s in base if s[3] == "hex")
