"""Quality classifier: naive-Bayes support vectors on indicators of character n-grams.

Indicators of hashed byte n-grams are scaled by the log ratio of their smoothed frequencies in the two classes, and
a linear model with hinge loss is fitted to them by dual coordinate descent. A logistic curve fitted to the
margins of rows that the model wasn't fitted on turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import in_small_batches, small_batches


#: Features behind the hashed n-grams: one word two, three and four times in a row.
REPEATS = 3


@dataclass(frozen=True)
class QualityParams:
    max_rows: int = 6000  # the model is fitted on this many labelled rows at most, drawn by a hash of the id
    buckets_bits: int = 16  # n-grams are hashed into 2**16 features
    sizes: tuple[int, ...] = (2, 3, 4)  # bytes of an n-gram
    smoothing: float = 1.0
    cost: float = 1.0  # of a row on the wrong side, before classes are balanced
    epochs: int = 12
    cut: float = 0.3  # a score of this or more predicts class 1
    seed: int = 17

    @property
    def features(self) -> int:
        return (1 << self.buckets_bits) + REPEATS


_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)
_BLOCK = 1 << 20


class Grams:
    """Distinct hashed n-grams of a whole text, as sorted feature numbers.

    They are the byte n-grams, and behind them the word n-grams (two to four words) of one word said again and again,
    with the word itself left out.
    """

    def __init__(self, p: QualityParams) -> None:
        self.p, self.seen = p, np.zeros(p.features, bool)

    def __call__(self, data: bytes | None) -> np.ndarray:
        self.seen[:] = False
        shift, reach = np.uint32(32 - self.p.buckets_bits), max(self.p.sizes) - 1
        raw = np.frombuffer(data or b"", np.uint8)
        for at in range(0, len(raw), _BLOCK):
            block = raw[max(0, at - reach) : at + _BLOCK].astype(np.uint32) + np.uint32(1)
            for size in self.p.sizes:
                n = len(block) - size + 1
                if n > 0:
                    h = np.full(n, np.uint32(size * 0x01000193), np.uint32)
                    for k in range(size):
                        h += block[k : k + n] * _FACTORS[k]
                        h ^= h >> np.uint32(15)
                    self.seen[(h * _FACTORS[5]) >> shift] = True
        words = data.split() if data else []
        again = bytes(map(eq, words, words[1:]))
        self.seen[-REPEATS:] = [b"\1" * n in again for n in range(1, REPEATS + 1)]
        return np.flatnonzero(self.seen).astype(np.int32)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, size: int, smoothing: float) -> np.ndarray:
    """log of (share of class 1 rows' indicators) / (share of class 0 rows'), smoothed."""
    count = lambda c: smoothing + np.bincount(np.concatenate([r for r, k in zip(rows, y, strict=True) if k == c]), minlength=size)
    p, q = count(1), count(0)
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit_hinge(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, costs: np.ndarray, epochs: int, seed: int) -> np.ndarray:
    """Weights of min |w|^2 / 2 + sum cost * hinge by dual coordinate descent; the last weight is the bias.

    Row i has the features rows[i] with the values values[rows[i]], scaled to length 1, and a bias feature of 1.
    """
    sign = np.where(y == 1, 1.0, -1.0)
    w, alpha = np.zeros(len(values) + 1), np.zeros(len(rows))
    scaled = [values[r] / max(np.linalg.norm(values[r]), 1e-12) for r in rows]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r, x = rows[i], scaled[i]
            gradient = sign[i] * (w[r] @ x + w[-1]) - 1.0
            new = min(max(alpha[i] - gradient / 2.0, 0.0), costs[i])  # |x|^2 with the bias feature is 2
            step = (new - alpha[i]) * sign[i]
            if step:
                w[r] += step * x
                w[-1] += step
                alpha[i] = new
    return w


def margin(row: np.ndarray, values: np.ndarray, weights: np.ndarray) -> float:
    x = values[row]
    length = np.sqrt(x @ x)
    return float((weights[row] @ x) / length + weights[-1]) if length > 0 else float(weights[-1])


def fit_curve(margins: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """a, b of the score 1 / (1 + exp(-(a * margin + b))), by Newton's method on smoothed targets; a is positive."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1.0) / (n1 + 2.0), 1.0 / (n0 + 2.0))
    a, b = 1.0, 0.0
    for _ in range(steps):
        s = 1.0 / (1.0 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = s - target, s * (1 - s) + 1e-9
        ga, gb = g @ margins + 1e-3 * a, g.sum()
        haa, hab, hbb = h @ margins**2 + 1e-3, h @ margins, h.sum() + 1e-9
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
        if abs(da) + abs(db) < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


@dataclass(frozen=True)
class QualityModel:
    """``scale`` are the log-count ratios, ``weights`` those of the hinge model, ``a`` and ``b`` the curve."""

    params: QualityParams
    scale: np.ndarray
    weights: np.ndarray
    a: float
    b: float


def _fit(rows: list[np.ndarray], y: np.ndarray, p: QualityParams) -> tuple[np.ndarray, np.ndarray, float, float]:
    size = p.features
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1.0) / (len(y) + 2.0)  # nothing to tell apart: every score is this share
        return np.zeros(size), np.zeros(size + 1), 1.0, float(np.log(share / (1 - share)))
    balance = np.where(y == 1, len(y) / (2.0 * (y == 1).sum()), len(y) / (2.0 * (y == 0).sum()))

    def model(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = [rows[i] for i in part]
        scale = log_count_ratios(some, y[part], size, p.smoothing)
        return scale, fit_hinge(some, scale, y[part], p.cost * balance[part], p.epochs, p.seed)

    # Margins of rows that a model hasn't seen, from two halves; then one model of all rows.
    half = np.arange(len(y)) % 2
    margins = np.zeros(len(y))
    for k in (0, 1):
        if len(set(y[half != k].tolist())) == 2:
            scale, weights = model(np.flatnonzero(half != k))
            for i in np.flatnonzero(half == k):
                margins[i] = margin(rows[i], scale, weights)
    a, b = fit_curve(margins, y)
    return *model(np.arange(len(y))), a, b


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", params: QualityParams | None = None) -> QualityModel:
    """Fit on rows of ``docs`` that ``labels`` (id, label 0 or 1) marks; others in ``labels`` are left out.

    At most ``max_rows`` labelled ids are used, those with the smallest hashes: this is the documented bound of the
    sample, and texts are read whole. Null labels and ids are left out; of several labels of an id the largest
    counts; of repeated rows of an id each counts. Features are made in parallel; the fit itself is one task on
    the bounded sample. With one class or no rows every score is the smoothed share of class 1.
    """
    p = params or QualityParams()
    in_small_batches(docs.sparkSession)
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    marked = marked.orderBy(F.xxhash64(F.lit(p.seed), id_col), id_col).limit(p.max_rows)
    sample = docs.select(id_col, F.encode(text_col, "UTF-8").alias("text")).join(F.broadcast(marked), id_col).select(
        F.xxhash64(F.lit(p.seed), id_col, "text").alias("at"), "text", F.col("y").cast("int").alias("y")
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(p)
        for batch in small_batches(batches, 1):
            rows = [grams(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2)], names=["at", "grams", "y"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(((at, g, y) for b in batches for at, g, y in zip(*(c.to_pylist() for c in b.columns), strict=True)))
        rows = [np.frombuffer(g, np.int32) for _, g, _ in found]
        scale, weights, a, b = _fit(rows, np.array([y for _, _, y in found], np.int64), p)
        arrays = [pa.array([x], kind) for x, kind in ((scale.tobytes(), pa.binary()), (weights.tobytes(), pa.binary()), (a, pa.float64()), (b, pa.float64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["scale", "weights", "a", "b"])

    made = sample.mapInArrow(features, "at long, grams binary, y int").repartition(1)
    row = made.mapInArrow(fit, "scale binary, weights binary, a double, b double").first()
    return QualityModel(p, np.frombuffer(bytes(row["scale"])), np.frombuffer(bytes(row["weights"])), row["a"], row["b"])


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1; higher: class 1 is likelier) and ``predicted`` (1 from the model's cut on).

    Whole texts are scored, whatever their length, from their n-grams alone; a null or empty text has the score of the
    bias. Repeated rows get equal scores. Input columns named like the new ones are replaced; all others, whatever their
    names, are kept. An empty table gives an empty table. Only texts go to Python, and only scores come back.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    in_small_batches(docs.sparkSession)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams = Grams(model.params)
        for column in columns:
            parts = small_batches([pa.RecordBatch.from_arrays([column], names=["text"])], 0)
            margins = [margin(grams(t), model.scale, model.weights) for part in parts for t in part.column(0).to_pylist()]
            yield pa.array(1.0 / (1.0 + np.exp(-np.clip(model.a * np.array(margins, np.float64) + model.b, -700, 700))))

    score = F.arrow_udf(run, "double").asNondeterministic()(F.encode(F.col(text_col), "UTF-8"))  # so that it runs once
    scored = docs.select(*[F.col(f"`{c}`") for c in kept], score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= model.params.cut).cast("int"))


def is_held_out(id_col: str = "doc_id"):
    """Rows that a model is never fitted on: crc32 of the id as text leaves 0 when divided by 5. False for null."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))
