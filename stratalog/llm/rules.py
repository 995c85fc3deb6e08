"""Quality rules: plain counts of a text, and how often its lines occur in other documents of its host."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import forget, in_small_batches, packed, small_batches, written
from stratalog.llm.shingles import WordHashes, odd_numbers, window_hashes

_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_WINDOW = 5


@dataclass(frozen=True)
class RuleParams:
    min_words: int = 10  # base rule: fewer words fail
    max_repeat_percent: int = 20  # base rule: a larger share of repeated words fails
    min_line_docs: int = 5  # a line in this many distinct documents of a host, or fewer, is never removed
    line_share: float = 0.02  # nor one in this share of the host's distinct documents, or less
    min_left_percent: int = 30  # a document that keeps fewer of its words is depleted
    of_texts: bool = False  # count distinct texts instead, so that copies of a document don't make its lines common


def _repeated_words(words: list[bytes], hashes: WordHashes, factors: np.ndarray) -> int:
    """Words that lie in a window of five words found twice or more."""
    if len(words) <= _WINDOW:
        return 0
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    windows = window_hashes(h, _WINDOW, factors)
    ordered = np.sort(windows)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0
    found = twice[np.minimum(np.searchsorted(twice, windows), len(twice) - 1)] == windows
    covered = np.zeros(len(words), bool)
    for k in range(_WINDOW):
        covered[k : k + len(found)] |= found
    return int(covered.sum())


def _measures(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Per row: id, hashes of host and text, counts, and hash and words of each of its lines (null without a word)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, factors = WordHashes(), odd_numbers(11, _WINDOW)
        for batch in small_batches(batches, 3):
            counts, lines, sizes = [], [], []
            for data in batch.column(3).to_pylist():
                data = data or b""
                words = data.split()
                chars = len(data.translate(None, _CONTINUATION + _SPACE))
                symbols = len(data) - len(data.translate(None, _SYMBOLS))
                every = data.split(b"\n")
                normal = [x.lower().split() for x in every]
                worded = [x for x, n in zip(every, normal, strict=True) if n]
                counts.append((len(words), chars, symbols, len(worded) - len(set(worded)), _repeated_words(words, hashes, factors)))
                lines.append([_signed(xxhash.xxh3_64_intdigest(b" ".join(n))) if n else None for n in normal])
                sizes.append([len(n) for n in normal])
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(names))]
            columns += [pa.array(lines, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["doc", "host", "text_hash", *names, "lines", "line_words"])

    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(host_col).alias("host"), F.xxhash64(text_col).alias("text_hash"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    counts = ", ".join(f"{n} long" for n in names)
    return texts.mapInArrow(run, f"doc {dict(texts.dtypes)['doc']}, host long, text_hash long, {counts}, lines array<long>, line_words array<long>")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, p: RuleParams) -> DataFrame:
    """The rows of ``_measures`` with removed_words, ``gone`` (numbers of the lines to remove), base_failed and kept."""
    in_small_batches(docs.sparkSession)
    rows = written(_measures(docs, id_col, text_col, host_col).withColumn("row", F.monotonically_increasing_id()), "measures")
    key = F.xxhash64("host", "line").alias("key")
    counted = F.col("text_hash" if p.of_texts else "doc").alias("counted")
    lines = rows.select("row", counted, "host", F.posexplode("lines").alias("at", "line"), "line_words").where("line IS NOT NULL")
    lines = lines.select("row", "counted", "host", key, "at", F.get("line_words", F.col("at")).alias("words"))
    seen = lines.groupBy("key", "counted").agg(F.first("host").alias("host"))
    often = seen.groupBy("key").agg(F.first("host").alias("host"), F.count("*").alias("docs"))
    often = written(often.where(F.col("docs") > p.min_line_docs), "often")
    hosts = rows.select("host", counted).distinct().groupBy("host").agg(F.count("*").alias("of_host"))
    common = often.join(written(hosts, "hosts"), "host").where(F.col("docs") > F.lit(p.line_share) * F.col("of_host"))
    common = written(common.select("key"), "common")
    hit = lines.select("row", "key", "at", "words").join(common, "key")
    removed = hit.groupBy("row").agg(F.sum("words").alias("removed_words"), F.collect_list("at").alias("gone"))
    judged = rows.join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    forget(often)
    failed = (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_percent * F.col("n_words"))
    left = 100 * (F.col("n_words") - F.col("removed_words")) >= p.min_left_percent * F.col("n_words")
    return judged.withColumns({"base_failed": failed, "kept": ~failed & left})


def judge_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", params: RuleParams | None = None
) -> DataFrame:
    """Per row of ``docs``: id, counts of its text, removed_words, base_failed and kept.

    A line is normalised (A-Z lower-cased, white space collapsed) and counted in the distinct documents of its host.
    Lines in more documents than both limits of ``params`` are removed; a document is depleted if less than
    ``min_left_percent`` of its words is left. Words are runs of characters other than ASCII white space. A null text
    has none and fails the base rule, as an empty one does; texts of any length are taken whole; null hosts are one
    host. Rows with equal ids are one document, and so are those with a null id. Repeated rows are judged alike. Other
    columns are ignored, whatever their names. An empty table gives an empty table.

    Counting has two aggregations, first over (line, document) and then over lines, both combined before the shuffle;
    the joins that look lines up are ones that adaptive execution can split. So neither a line of every document
    nor a host of a third of them is a hot spot.
    """
    judged = _judged(docs, id_col, text_col, host_col, params or RuleParams())
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept")
    return judged.select(F.col("doc").alias(id_col), *counts)


def clean_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", params: RuleParams | None = None
) -> DataFrame:
    """The rows of ``docs`` that ``judge_documents`` keeps, without their common lines; all columns, whatever their names.

    The lines that stay are as they were, with the same line ends between them. Null, blank and short texts fail the base rules
    and go; repeated rows stay repeated; texts of any length are cleaned whole. An empty table gives an empty table. Texts are
    shuffled once.
    """
    judged = _judged(docs, id_col, text_col, host_col, params or RuleParams()).where("kept")
    judged = judged.select("doc", "host", "text_hash", "gone").dropDuplicates(["doc", "host", "text_hash"])  # rows can be repeated
    place = [F.col(id_col).alias("doc"), F.xxhash64(host_col).alias("host"), F.xxhash64(text_col).alias("text_hash")]
    rows = docs.select(packed(docs, [text_col]).alias("rest"), F.col(text_col).alias("text"), *place).alias("d")
    both = rows.join(judged.alias("j"), F.expr("d.doc <=> j.doc AND d.host = j.host AND d.text_hash = j.text_hash"))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)
    return both.select(*[text.alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns])
