import zlib
from collections import defaultdict

import numpy as np
from stratalog.llm import mixing, packing, tokens
from stratalog.llm.tokens import tokenizer_path

from tests.llm.fixtures import documents, frame


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, left, target = share * sum(sizes.values()), set(names), {}
    while left:
        per = budget / sum(weight[s] for s in left)
        over = [s for s in left if per * weight[s] >= most * sizes[s]]
        for s in over or left:
            target[s] = most * sizes[s] if over else per * weight[s]
        if not over:
            break
        budget -= sum(target[s] for s in over)
        left -= set(over)
    return target


def test_mix_meets_targets(spark):
    got = mixing.mix_sources(frame(spark, extra=True).drop("size")).collect()
    rows = documents()
    assert len(got) == len(rows)
    sizes, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, text, _, source, _ in rows:
        n = len((text or "").encode().split())
        sizes[source] += n
        largest[source] = max(largest[source], n)
    target = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert sum(taken.values()) == int(1.5 * sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] + 1
    again = mixing.mix_sources(frame(spark).repartition(7)).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in got) == sorted((r.doc_id or -1, r.taken) for r in again)
    assert mixing.mix_sources(frame(spark, [])).collect() == []


def test_mix_of_nothing_but_empty_texts(spark):
    got = mixing.mix_sources(frame(spark, [(1, "", "en", "a", 0), (2, None, "en", None, 0)])).collect()
    assert [(r.size, r.taken, r.copies) for r in got] == [(0, 0, 1)] * 2


def test_pieces_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    rows = [*documents(plain=20), (5000, "Don't stop <|endoftext|> I'll say'll ok... ﬁne İstanbul Á!? 12,5", "en", "s", 1), (5001, "tab\tand space wide", "en", "s", 1)]
    got = packing.tokenized_pieces(frame(spark, rows)).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = set()
    for i, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4").tobytes()
            want.add((i, k // 2048, k, len(part) // 4, zlib.crc32(part)))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)


ODD_TEXTS = ["", None, " \n ", "  ahead", "it's... x'sy 'S 'll.", "12,5 a1b2?!", "<|endoftext|> a", "a\0b \0 \0\0. c", "İ. xİ! İİ"]
ODD_TEXTS += ["a\xa0b\u2003c \x1cd\x85e \u3000", "ΑΣ Σ. Ж.б! жЖ", "\u212a ﬁ ªº µ ẞ ŉ ǅ", "é!! É. e\u0301. E\u0301\u0300", "漢字 かな。 \U0001f600yes.", "a\u0338 <\u0338 =\u0338", "x" * 500 + "."]
#: Capitals that compose with no mark where their small letters do: composing comes before lower-casing.
ODD_TEXTS += ["H\u0331e t", "T\u0308x", "W\u030a", "Y\u030a a", "J\u030c", "W\u1dc2\u030a"]


def test_ids_of_odd_texts_are_the_tokenizers():
    encode = tokens.PieceEncoder(tokenizer_path())
    rng = np.random.default_rng(5)
    letters = [*map(chr, range(0x20, 0x530)), *"\0.,!' '\t\nsHTWYJ" * 40, *"\u0300\u0308\u030a\u030c\u0323\u0331\u1dc2\u2003\u1100\u1161\uac00" * 4]
    mixed = ["".join(rng.choice(letters, 40)) for _ in range(1500)]
    for texts in (ODD_TEXTS, ODD_TEXTS, [], [None], mixed):  # the second time the pieces are known
        got = encode([None if t is None else t.encode() for t in texts])
        for t, ids in zip(texts, got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == encode.tokenizer.encode(t or "", add_special_tokens=False).ids, ascii(t)


def test_a_worker_encodes_pieces_together_and_once(monkeypatch):
    """Words that differ in their ends only, also after letters beyond ASCII, cost few calls; known ones cost none in later tasks."""
    encode = tokens.encoder(tokenizer_path())
    assert tokens.encoder(tokenizer_path()) is encode
    asked, ids = [], tokens.PieceEncoder._ids
    monkeypatch.setattr(tokens.PieceEncoder, "_ids", staticmethod(lambda tokenizer, texts: asked.extend(texts) or ids(tokenizer, texts)))
    words = [f"{a}{b}{c}é" for a in "bcdfghjklm" for b in "aeiouäöü" for c in "nprstvwxyz"]
    text = " ".join(f"{w}{end}" for w in words for end in (".", "!!", ",", "")).encode()
    first = encode([text])
    assert len(asked) <= len(words) // 100
    assert " ".join(asked).count("é") == len(words)
    asked.clear()
    assert encode([text]) == first and asked == []


def test_remembered_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED_BYTES", 4000)
    encode = tokens.PieceEncoder(tokenizer_path())
    for k in range(20):
        text = " ".join(["the", "of", *(f"w{k}x{i}" for i in range(60)), "y" * 3000])
        assert np.frombuffer(encode([text.encode()])[0], "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids
        assert sum(map(len, encode.pieces.to_pylist())) + encode.table.nbytes <= 4000 and len(encode.pieces) <= 4000 // 32
        assert len(encode.pieces) == len(encode.starts) == len(encode.sizes) == len(encode.met)


def check_layout(rows, capacity):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_is_gapless_and_tight(spark):
    pieces = packing.tokenized_pieces(frame(spark), with_ids=False)
    got = packing.pack(pieces, order=("doc_id", "piece", "ids_crc32")).collect()
    assert len(got) == pieces.count()
    bound = -(-sum(r.length for r in got) // 2048)
    assert check_layout(got, 2048) <= bound + 1
    assert packing.pack(packing.tokenized_pieces(frame(spark, [])), order=("doc_id",)).collect() == []


def test_two_fit_beats_greedy(spark):
    """Greedy puts 5 and 4 into 10; replacing the 4 by 3 and 2 fills the bin."""
    counts = np.zeros(11, np.int64)
    counts[[5, 4, 3, 2]] = 1
    plan = packing.plan_bins(counts, 10)
    assert plan.sequences == 2
    first = {int(k) >> 40 for k, s in zip(plan.key, plan.sequence, strict=True) if s == 0}
    assert first == {5, 3, 2}


def test_plan_covers_every_piece():
    rng = np.random.default_rng(3)
    for _ in range(30):
        capacity = int(rng.integers(3, 60))
        counts = np.zeros(capacity + 1, np.int64)
        counts[1:] = rng.integers(0, 9, capacity) * rng.integers(0, 2, capacity)
        plan = packing.plan_bins(counts, capacity)
        fill = np.zeros(plan.sequences, np.int64)
        for length in range(1, capacity + 1):
            at = (length << 40) + np.arange(counts[length])
            i = np.searchsorted(plan.key, at, "right") - 1
            np.add.at(fill, plan.sequence[i] + (at - plan.key[i]) // plan.uses[i], length)
        assert fill.sum() == (counts * np.arange(capacity + 1)).sum() and (fill <= capacity).all() and (fill > 0).all()
