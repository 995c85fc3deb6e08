"""Fill-in-middle: cut a text at two borders of its units and move the middle to the end.

A unit is a run of letters A-Z, a-z, or any other single character. Characters fall into four classes, and the class
that goes on with a run is the only one that begins no unit: the units that begin within the first i characters are the
ranks of the other classes at i, added up. A wavelet matrix over the classes answers a rank in two steps whatever i is,
and bisection on these counts finds the character that a unit begins at. One matrix serves all texts of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import in_small_batches, small_batches

#: Classes of characters: a letter that goes on with a run, one that begins a run, other ASCII, everything else.
INNER_LETTER, FIRST_LETTER, ASCII, OTHER = range(4)
_STARTS = (FIRST_LETTER, ASCII, OTHER)


@dataclass(frozen=True)
class InfillParams:
    seed: int = 1
    plain_percent: int = 10  # texts that stay as they are
    spm_percent: int = 20  # of the others, those whose suffix comes first
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


class WaveletMatrix:
    """Ranks of small symbols: a bit vector for each bit of the symbols, from the highest, with the zeros moved to the front."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.levels = bits, []
        for place in range(bits - 1, -1, -1):
            bit = ((symbols >> place) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(symbols) // 64 + 1, "<u8")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((words, before, len(symbols) - int(bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before each place."""
        lo, hi = np.zeros_like(at), at
        for place, (words, before, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            ones = [before[i >> 6] + np.bitwise_count(words[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))) for i in (lo, hi)]
            lo, hi = (zeros + ones[0], zeros + ones[1]) if (symbol >> place) & 1 else (lo - ones[0], hi - ones[1])
        return hi - lo


def character_classes(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Class of each code point; ``begins`` has the places where texts begin."""
    low = codes | 0x20
    letter = (low >= ord("a")) & (low <= ord("z")) & (codes < 128)
    goes_on = np.zeros(len(codes), bool)
    goes_on[1:] = letter[1:] & letter[:-1]
    goes_on[begins[begins < len(codes)]] = False
    return np.where(letter, np.where(goes_on, INNER_LETTER, FIRST_LETTER), np.where(codes < 128, ASCII, OTHER)).astype(np.uint8)


def locate(texts: list[bytes], draws: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The number of units of each text, and the characters before the (draw mod units + 1)-th border, smallest draw first."""
    codes = [np.frombuffer(t.decode().encode("utf-32-le"), "<u4") for t in texts]
    ends = np.cumsum([len(c) for c in codes], dtype=np.int64)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    matrix = WaveletMatrix(character_classes(np.concatenate(codes) if codes else np.zeros(0, "<u4"), begins), 2)
    started = lambda at: sum(matrix.rank(c, at) for c in _STARTS)
    base = started(begins)
    units = started(ends) - base
    cuts = []
    for wanted in np.sort([d % (units + 1) for d in draws], axis=0):
        lo, hi = begins.copy(), ends.copy()
        while (open_ := lo < hi).any():  # the first character that begins unit number ``wanted``, counted from 0
            mid = (lo + hi) >> 1
            enough = started(np.where(open_, mid + 1, 0)) - base > wanted
            hi = np.where(open_ & enough, mid, hi)
            lo = np.where(open_ & ~enough, mid + 1, lo)
        cuts.append(lo - begins)
    return units, cuts


def _cut(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    names = ["units", "first", "second"]
    for arrays in columns:
        out = [[] for _ in names]
        for part in small_batches([pa.RecordBatch.from_arrays(list(arrays), names=["text", "a", "b"])], 0):
            units, cuts = locate([t or b"" for t in part.column(0).to_pylist()], [part.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)])
            for values, more in zip(out, (units, *cuts), strict=True):
                values.append(more)
        yield pa.StructArray.from_arrays([pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for v in out], names=names)


def draws(id_text: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 that hang on the seed and the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: InfillParams | None = None) -> DataFrame:
    """``docs`` with ``n_units``, ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``.

    Both cuts lie at borders of units, drawn by seed and id, so a rerun gives the same. ``psm`` is prefix, suffix and
    middle, each behind its mark; ``spm`` begins with the suffix. A text that is null, empty or holds a mark stays plain,
    besides a share of all. Texts of any length are taken whole. Rows with a null id draw as an empty id does, and
    repeated rows are formed alike. Columns named like the new ones are replaced, all others are kept whatever their
    names. An empty table gives an empty table. Only texts and draws go to Python, and only three numbers come back.
    """
    p = params or InfillParams()
    new = ("n_units", "form", "prefix_chars", "middle_chars", "output")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    in_small_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    one, two, three, four = draws(F.col(f"`{id_col}`").cast("string"), p.seed)
    cut = F.arrow_udf(_cut, "struct<units:long,first:long,second:long>").asNondeterministic()(F.encode(text, "UTF-8"), one, two)  # so that it runs once
    marked = text.contains(p.prefix) | text.contains(p.suffix) | text.contains(p.middle)
    plain = (text == "") | marked | (three % 100 >= 100 - p.plain_percent)
    form = F.when(plain, "plain").when(four % 100 < p.spm_percent, "spm").otherwise("psm")
    made = docs.select(F.struct(*kept).alias("row"), text.alias("whole"), form.alias("form"), cut.alias("cut"))
    at = lambda a, b: F.substr(F.col("whole"), (a + 1).cast("int"), (b - a).cast("int"))
    first, second = F.col("cut.first"), F.col("cut.second")
    parts = {p.prefix: at(F.lit(0), first), p.middle: at(first, second), p.suffix: at(second, F.length("whole"))}
    lay = lambda *marks: F.concat(*[x for m in marks for x in (F.lit(m), parts[m])])
    output = F.when(F.col("form") == "plain", F.col("whole")).when(F.col("form") == "spm", lay(p.suffix, p.prefix, p.middle)).otherwise(lay(p.prefix, p.suffix, p.middle))
    moved = F.col("form") != "plain"
    return made.select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c not in new],
        F.col("cut.units").alias("n_units"),
        "form",
        F.when(moved, first).alias("prefix_chars"),
        F.when(moved, second - first).alias("middle_chars"),
        output.alias("output"),
    )


def restore(output: Column, form: Column, params: InfillParams | None = None) -> Column:
    """The text that an output was made of. A moved text holds no mark, so the marks of the output cut it exactly."""
    p = params or InfillParams()
    parts = F.split(output, "|".join(f"\\Q{m}\\E" for m in p.marks()), -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(F.concat(part(1), part(3), part(2)))
