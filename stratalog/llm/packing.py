"""Best-two-fit packing of tokenized documents into sequences of fixed capacity.

A bin is filled greedily, the largest piece that fits first; then its smallest piece is replaced by two unpacked
pieces if these fill the widened gap more tightly. Pieces of one length are interchangeable, so all bins are planned
on the histogram of lengths, which has ``capacity`` entries whatever the input: equal bins become one pattern with a
multiplicity. The rows then find their bin by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import BATCH_BYTES, forget, in_small_batches, packed, running, small_batches, written
from stratalog.llm.tokens import encoder, tokenizer_path

#: Texts encoded at a time, if they have not more bytes than Arrow batches may have.
_BATCH = 10_000


def tokenized_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    path: str | None = None,
    end_id: int = 0,
    with_ids: bool = True,
) -> DataFrame:
    """Per piece of each document: id, piece, start, length, ids_crc32 and (if asked for) ids as bytes.

    A document's ids are those of its text and ``end_id``; a null or empty text has ``end_id`` alone. Only documents
    longer than ``capacity`` are cut, every ``capacity`` ids. Ids are little-endian unsigned 32-bit numbers.
    Null ids, repeated rows and other columns are no matter: each row is a document. Texts of any length are encoded whole,
    and a batch of texts with its ids is in memory at a time. An empty table gives an empty table.
    """
    path = path or tokenizer_path()
    in_small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in small_batches(batches, 1, _BATCH, BATCH_BYTES):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, data in enumerate(encode(batch.column(1).to_pylist())):
                data += end
                for k in range(0, len(data), 4 * capacity):
                    part = data[k : k + 4 * capacity]
                    row.append(i)
                    piece.append(k // (4 * capacity))
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    ids.append(part)
            columns = [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc)] + [pa.array(ids, pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    texts = docs.select(F.col(id_col).alias("doc"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    schema = f"doc {dict(texts.dtypes)['doc']}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return texts.mapInArrow(run, schema).withColumnRenamed("doc", id_col)


@dataclass(frozen=True)
class Plan:
    """Where the pieces of each length go, in the order of their ranks: sorted by ``key`` = length << 40 | first rank."""

    key: np.ndarray
    sequence: np.ndarray  # first of the pattern's sequences
    uses: np.ndarray  # pieces of this length in one sequence
    offset: np.ndarray  # place of the first of them
    sequences: int


def _two_for(least: int, room: int, left: np.ndarray, uses: dict[int, int], lengths: np.ndarray) -> tuple[int, int]:
    """The two unpacked lengths, other than ``least``, that fill ``room`` best together; 0, 0 if no two fit."""
    free = left.copy()
    for s, n in uses.items():
        free[s] -= n
    free[least] = 0
    upto = np.maximum.accumulate(np.where(free > 0, lengths, 0))
    a = np.flatnonzero(free[:room] > 0)
    if not len(a):
        return 0, 0
    b = upto[np.minimum(room - a, a)]
    once = (b == a) & (free[a] < 2)
    b[once] = upto[a[once] - 1]
    total = np.where(b > 0, a + b, 0)
    best = int(np.argmax(total))
    return (int(a[best]), int(b[best])) if total[best] else (0, 0)


def plan_bins(counts: np.ndarray, capacity: int) -> Plan:
    """Plan all bins for ``counts[length]`` pieces of each length from 1 to ``capacity``."""
    left = counts.astype(np.int64).copy()
    given = np.zeros_like(left)
    rows: list[tuple[int, int, int, int]] = []
    sequences = 0
    lengths = np.arange(capacity + 1)
    # Largest length with pieces left at or below each length; brought up to date when a length runs out.
    upto = np.maximum.accumulate(np.where(left > 0, lengths, 0))
    while upto[capacity]:
        uses: dict[int, int] = {}
        gap = capacity
        while (size := int(upto[gap])) and gap:
            n = min(gap // size, int(left[size]) - uses.get(size, 0))
            if n == 0:  # all pieces of this length are in the bin already
                smaller = upto[size - 1]
                if not smaller:
                    break
                size = int(smaller)
                while size and (n := min(gap // size, int(left[size]) - uses.get(size, 0))) == 0:
                    size = int(upto[size - 1])
                if not size:
                    break
            uses[size] = uses.get(size, 0) + n
            gap -= n * size
        if gap:
            least = min(uses)
            x, y = _two_for(least, gap + least, left, uses, lengths)
            if x + y > least:
                uses[least] -= 1
                for s in (x, y):
                    uses[s] = uses.get(s, 0) + 1
        uses = {s: n for s, n in uses.items() if n}
        times = min(int(left[s]) // n for s, n in uses.items())
        offset = 0
        out = False
        for s in sorted(uses, reverse=True):
            n = uses[s]
            rows.append(((s << 40) | int(given[s]), sequences, n, offset))
            offset += s * n
            given[s] += n * times
            left[s] -= n * times
            out |= left[s] == 0
        sequences += times
        if out:
            upto = np.maximum.accumulate(np.where(left > 0, lengths, 0))
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Plan(table[:, 0], table[:, 1], table[:, 2], table[:, 3], sequences)


def pack(pieces: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have a ``length`` from 1 to ``capacity``.

    The sequences hold the pieces without gaps from offset 0. All columns are kept, whatever their names; input columns
    with one of the two new names are replaced. Among pieces of one length ``order`` decides who goes where; rows equal
    in it are interchangeable, so repeated rows and nulls are no matter. An empty table gives an empty table. The
    driver sees the counts of the lengths (``capacity`` numbers) and the plan made of them. A piece's rank among those of
    its length comes from one range sort by length and ``order``, so a length that most pieces have is no hot spot.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    keys = [f"key {i}" for i in range(len(order))]
    rows = pieces.select(packed(pieces.select(*[F.col(f"`{c}`") for c in kept])).alias("row"), F.col("length").cast("long").alias("length"), *[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)])
    rows = written(rows, "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in rows.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[row["length"]] = row["n"]
    plan = plan_bins(counts, capacity)
    shorter = np.cumsum(counts) - counts
    ranked = running(rows, ["length", *keys]).select("row", "length", "rank")
    forget(rows)

    def place(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for length, rank in columns:
            n = length.to_numpy(zero_copy_only=False).astype(np.int64)
            at = (n << 40) + rank.to_numpy(zero_copy_only=False).astype(np.int64) - shorter[n]
            i = np.searchsorted(plan.key, at, "right") - 1
            nth = at - plan.key[i]
            sequence = plan.sequence[i] + nth // plan.uses[i]
            offset = plan.offset[i] + (nth % plan.uses[i]) * n
            yield pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    placed = F.arrow_udf(place, "sequence_id long, offset long").asNondeterministic()("length", "rank")  # so that it runs once
    out = ranked.select("row", placed.alias("at"))
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "at.sequence_id", "at.offset")
