"""Small tables with the awkward cases that every operator must take: nulls, empty and long texts, ties, repeats."""

from __future__ import annotations

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def documents(seed: int = 1, plain: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    out = [(i, words(rng, rng.randint(5, 160)), rng.choice(["en", "fr", None]), f"src{i % 4}") for i in range(plain)]
    base = words(rng, 120).split()
    for k in range(12):  # near copies: one word of 120 differs
        near = list(base)
        near[rng.randrange(len(near))] = f"edit{k}"
        out.append((1000 + k, " ".join(near), "en", "src0"))
    out += [(2000 + k, " ".join(base), "en", "src1") for k in range(8)]  # exact copies
    passage = words(rng, 70)
    out += [(3000 + k, f"{words(rng, 40)} {passage} {words(rng, 30)}", "de", "src2") for k in range(6)]
    out += [
        (4000, None, None, None),
        (4001, "", "en", None),
        (4002, " \t\n ", "en", "src3"),
        (4003, "one", "en", "src3"),
        (4004, "One", "en", "src3"),
        (4005, words(rng, 30_000), "en", "src3"),
        (4006, "same same same same same same same same same same same same", "en", "src3"),
        (4006, "same same same same same same same same same same same same", "en", "src3"),
        (None, "a text whose id is null and which stands alone here", "en", "src1"),
        (4007, "Ünïcödé wörds ärë fïne töö — \U0001f600 yes", "xx", "src1"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in out]


def frame(spark, rows=None, extra: bool = False):
    df = spark.createDataFrame(documents() if rows is None else rows, DOC_SCHEMA).repartition(3)
    if extra:  # columns that clash with names the operators use inside
        for name in ("doc", "row", "node", "digest", "cell", "size", "component", "length", "score", "spans", "order"):
            df = df.selectExpr("*", f"1 AS `{name}`")
    return df
