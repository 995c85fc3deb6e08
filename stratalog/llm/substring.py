"""Substring dedup: content-defined chunks cut by a gear rolling hash, deduplicated by digest.

Where a chunk ends depends only on the last few bytes, so a passage has the same chunks in every document from its
first cut on, whatever stands before it. Cuts are moved on to the next word; any white space between words is the same.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import forget, in_small_batches, packed, small_batches, written
from stratalog.llm.shingles import odd_numbers

#: Bytes that the rolling hash is computed over at a time.
_BLOCK = 1 << 20


@dataclass(frozen=True)
class SubstringParams:
    mean_bytes: int = 24  # mean distance of cuts before they move to a word's beginning
    min_words: int = 20  # a run of duplicate chunks with fewer words stays
    seed: int = 5


def gear_table(seed: int) -> np.ndarray:
    return (odd_numbers(seed, 256) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """h[i] = sum of table[data[i - k]] << k over k < 32, modulo 2**32: the gear hash at every byte at once."""
    h = table[data]
    for step in (1, 2, 4, 8, 16):
        moved = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += moved
    return h


def cut_chunks(words: list[bytes], table: np.ndarray, mean_bytes: int) -> np.ndarray:
    """Number of the first word of each chunk, for a text of at least one word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    raw = np.frombuffer(b" ".join(words), np.uint8)
    limit = np.uint32((1 << 16) // mean_bytes)
    ends = []
    for at in range(0, len(raw), _BLOCK):
        back = min(at, 32)
        h = gear_hashes(raw[at - back : at + _BLOCK], table)[back:]
        # Bits 8 to 23: they depend on the last 24 bytes at most, so chunks fall in step soon.
        ends.append(np.flatnonzero(((h >> np.uint32(8)) & np.uint32(0xFFFF)) < limit) + at)
    cut = np.searchsorted(starts, np.concatenate(ends), "right")
    return np.unique(np.concatenate([[0], cut[cut < len(words)]]))


def word_places(data: bytes) -> np.ndarray:
    """Place of each word's beginning in code points."""
    raw = np.frombuffer(data, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    return np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)[starts] - 1


def _chunk_table(data: bytes, table: np.ndarray, mean_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each chunk of a text: its digest as a signed 64-bit number, its words, and where it begins in code points."""
    own = data.split()
    if not own:
        return (np.empty(0, np.int64),) * 3
    at = cut_chunks(own, table, mean_bytes)
    to = [*at[1:].tolist(), len(own)]
    hashed = [xxhash.xxh3_64_intdigest(b" ".join(own[a:b])) for a, b in zip(at.tolist(), to, strict=True)]
    places = word_places(data)[at]
    places[:1] = 0
    return np.array(hashed, np.uint64).view(np.int64), np.diff([*at, len(own)]), places


def _chunks(docs: DataFrame, id_col: str, text_col: str, p: SubstringParams) -> DataFrame:
    """Per row: id, hash of the text, and digests, words and places of its chunks, in order; rows without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gear_table(p.seed)
        for batch in small_batches(batches, 2):
            found = [_chunk_table(data, table, p.mean_bytes) if data else None for data in batch.column(2).to_pylist()]
            rows = pa.array([i for i, x in enumerate(found) if x and len(x[0])], pa.int32())
            found = [x for x in found if x and len(x[0])]
            ends = pa.array(np.cumsum([0, *[len(x[0]) for x in found]]), pa.int32())
            flat = [np.concatenate([x[k] for x in found] or [np.empty(0)]) for k in range(3)]
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(t))) for x, t in zip(flat, (np.int64, np.int32, np.int32), strict=True)]
            columns = [batch.column(0).take(rows), batch.column(1).take(rows), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "text_hash", "digests", "words", "places"])

    text = F.col(text_col)
    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("text_hash"), F.encode(text, "UTF-8").alias("text"))
    kind = dict(texts.dtypes)["doc"]
    return texts.mapInArrow(run, f"doc {kind}, text_hash long, digests array<long>, words array<int>, places array<int>")


def passages(digests: list[int], sizes: list[int], first_of: dict, min_words: int) -> list[tuple[int, int]]:
    """Runs (first chunk, end) of duplicate chunks that are long enough; ``first_of`` has the first document of each.

    Repeated chunks count once, and half of the words must come from one document: common short chunks that
    happen to follow each other are no passage.
    """
    dup = np.array([d in first_of for d in digests], np.int8)
    out = []
    for a, b in np.flatnonzero(np.diff(dup, prepend=0, append=0)).reshape(-1, 2).tolist():
        of_doc = Counter()
        for d, n in dict(zip(digests[a:b], sizes[a:b], strict=True)).items():
            of_doc[first_of[d]] += n
        n = sum(of_doc.values())
        if n >= min_words and 2 * max(of_doc.values()) >= n:
            out.append((a, b))
    return out


def _marks(rows: DataFrame, p: SubstringParams) -> DataFrame:
    """(doc, text_hash, digests, words, places, known, firsts) -> (doc, text_hash, dup_chunks, removed_words, spans, first_docs)."""
    kinds = dict(rows.dtypes)

    def mark(digests: list[int], words: list[int], places: list[int], first_of: dict) -> tuple:
        found = passages(digests, words, first_of, p.min_words)
        spans = [{"start": places[a], "end": places[b] if b < len(places) else -1} for a, b in found]
        docs = sorted({first_of[d] for a, b in found for d in digests[a:b]})
        return sum(d in first_of for d in digests), sum(sum(words[a:b]) for a, b in found), spans or None, docs or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, w, at, known, firsts = (batch.column(i) for i in range(2, 7))
            done = [mark(d[i].as_py(), w[i].as_py(), at[i].as_py(), dict(zip(known[i].as_py(), firsts[i].as_py(), strict=True))) for i in range(batch.num_rows)]
            made = [pa.array([x[k] for x in done], pa.int64()) for k in (0, 1)]
            made.append(pa.array([x[2] for x in done], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
            made.append(pa.array([x[3] for x in done], batch.schema.field(6).type))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], names=["doc", "text_hash", "dup_chunks", "removed_words", "spans", "first_docs"])

    rows = rows.select("doc", "text_hash", "digests", "words", "places", "known", "firsts")
    made = f"dup_chunks long, removed_words long, spans array<struct<start:int,end:int>>, first_docs {kinds['firsts']}"
    return rows.mapInArrow(run, f"doc {kinds['doc']}, text_hash long, {made}")


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` without ``spans`` (start and end in code points, in order; an end of -1 is the end of the text)."""
    left = F.transform(
        F.sequence(F.lit(0), F.size(spans)),
        lambda i: F.struct(
            F.when(i == 0, 0).otherwise(F.get(spans, i - 1).end).alias("a"), F.coalesce(F.get(spans, i).start, F.length(text)).alias("b")
        ),
    )
    piece = lambda x: F.when(x.a >= 0, F.substr(text, x.a + 1, x.b - x.a)).otherwise(F.lit(""))
    return F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, F.array_join(F.transform(left, piece), "")).otherwise(text)


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: SubstringParams | None = None) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text_col``, and dup_chunks, removed_words, spans, first_docs added.

    A chunk is a duplicate in a document if a document with a smaller id has it too. Runs of duplicate chunks with
    at least ``min_words`` words in distinct chunks, half of them first seen in one document, are cut out; other runs
    stay, so common phrases and lines do. ``spans`` are the cut places (start and end in code points of the old text;
    the end of the text is -1), ``first_docs`` the documents that first have the chunks of these runs; both are null
    where nothing is cut. A passage of over 50 words loses a chunk or so at either end to its neighbours, which stays.

    A null text stays null; a text without words is left alone. Rows with a null id never count as first, but lose what
    a row with an id has. Rows with equal ids are one document: they aren't duplicates of each other. Texts of any length
    are taken whole. Input columns named like the added ones are replaced, all others are kept. An empty table gives an
    empty table.

    Texts are read into chunks once. Digests are counted with map-side combining; only shared ones are joined back to the
    rows that have them, by a join that adaptive execution can split. What is cut is decided on the
    digests; texts are shuffled once, to meet their cuts, which Spark makes.
    """
    p = params or SubstringParams()
    in_small_batches(docs.sparkSession)
    added = ("dup_chunks", "removed_words", "spans", "first_docs")
    chunks = written(_chunks(docs, id_col, text_col, p).withColumn("row", F.monotonically_increasing_id()), "chunks")
    own = chunks.select("row", "doc", F.explode(F.array_distinct("digests")).alias("digest"))
    held = own.groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    held = written(held, "held")
    found = own.join(held.select("digest", "first"), "digest").where("doc IS NULL OR first < doc")
    found = found.groupBy("row").agg(F.collect_list(F.struct("digest", "first")).alias("x"))
    known = chunks.join(found, "row").select("doc", "text_hash", "digests", "words", "places", F.col("x.digest").alias("known"), F.col("x.first").alias("firsts"))
    marks = written(_marks(known, p), "marks")
    forget(chunks, held)
    marks = marks.dropDuplicates(["doc", "text_hash"])  # rows can be repeated

    kept = [c for c in docs.columns if c not in added]
    rest = packed(docs, [text_col, *added]).alias("rest")
    rows = docs.select(rest, F.col(text_col).alias("text"), F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_hash")).alias("d")
    both = rows.join(marks.alias("k"), F.expr("d.doc <=> k.doc AND d.text_hash = k.text_hash"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select(
        *[without_spans(F.col("text"), F.col("spans")).alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in kept],
        zero("dup_chunks"),
        zero("removed_words"),
        "spans",
        "first_docs",
    )
