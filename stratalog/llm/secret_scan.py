"""Secrets in texts: patterns, and character Markov models of random strings and ordinary names, with Spark expressions alone."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that strings are made of; any other stands for the border before the first one.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SIZE = len(ALPHABET) + 1


@dataclass(frozen=True)
class Kind:
    """A pattern, the group of it that must have ``least`` characters, and a cheap test that every match passes."""

    name: str
    pattern: str
    group: int
    least: int
    hint: str


#: Matches too short in their group are dropped, but what they cover is used up. Hexadecimal digits and keys that are
#: too short cover no beginning of a longer one, so their patterns ask for the length at once.
KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"""(?i)(?:passw|secret|token|api_?key)[a-z]*["']?\x20*[:=]"""),
    Kind("access", r"AKIA[A-Z0-9]{16,}", 0, 20, "AKIA"),
    Kind("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
)
#: The kind that the models add: strings of this many characters at least.
RANDOM = "random"
LEAST_RANDOM = 16
_SPAN = "array<struct<start:bigint,order:int,end:bigint,kind:string,text:string>>"


@dataclass(frozen=True)
class MarkovModel:
    """Log ratio of the probabilities of each character behind each other one, random over ordinary; ``cut`` in nats a string."""

    ratios: np.ndarray
    cut: float


def _codes(text: Column) -> Column:
    """The characters of a text as places in the alphabet from 1; 0 for another one."""
    places = [0] * 128
    for i, c in enumerate(ALPHABET, 1):
        places[ord(c)] = i
    table = F.lit(np.array(places, np.int32))
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.coalesce(F.get(table, F.ascii(c)), F.lit(0)))


def fit_markov(samples: DataFrame, text_col: str = "text", label_col: str = "label", smoothing: float = 0.2, cut: float = 14.0) -> MarkovModel:
    """First-order chains of the strings with label 1 (random) and 0 (ordinary), smoothed towards equal chances.

    Null or empty strings and other labels are left out; repeated rows count each. What reaches the driver are the
    counts of pairs of characters, 2 * 68 * 68 at most, whatever the size of ``samples``. ``cut`` is the log odds
    against a string being a secret before it is looked at. Without any sample every ratio is 0 and nothing is found.
    """
    codes = F.concat(F.array(F.lit(0)), _codes(F.col(text_col)))
    known = samples.where(F.col(label_col).isin(0, 1) & (F.length(text_col) > 0)).select(F.col(label_col).cast("int").alias("label"), codes.alias("c"))
    pairs = known.select("label", F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.get("c", i) * _SIZE + F.get("c", i + 1))).alias("pair"))
    counts = np.zeros((2, _SIZE * _SIZE))
    for r in pairs.groupBy("label", "pair").count().collect():
        counts[r.label, r.pair] = r["count"]
    counts = counts.reshape(2, _SIZE, _SIZE) + smoothing
    chances = np.log(counts / counts.sum(axis=2, keepdims=True))
    return MarkovModel((chances[1] - chances[0]).ravel(), cut)


def log_likelihood_ratio(text: Column, model: MarkovModel) -> Column:
    """How much likelier a string is as a random one than as an ordinary one, in nats."""
    table = F.lit(np.asarray(model.ratios, np.float64))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("last"))
    step = lambda s, c: F.struct((s["sum"] + F.get(table, s["last"] * _SIZE + c)).alias("sum"), c.alias("last"))
    return F.aggregate(_codes(text), start, step, lambda s: s["sum"])


def _running(sizes: Column) -> Column:
    """Sums of an array up to and with each element, in as many rounds as its length has binary digits."""
    add = lambda sums, k: F.transform(sums, lambda x, i: x + F.when(i >= k, F.get(sums, i - k)).otherwise(F.lit(0).cast("long")))
    rounds = F.transform(F.sequence(F.lit(0), F.length(F.bin(F.size(sizes)))), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    return F.aggregate(rounds, sizes, add)


def occurrences(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches from the left, without overlap: start, end (code points; from 0, exclusive), text, and the text of ``group``.

    Offsets are running sums of the lengths of the matches and of what lies between them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inside = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)
    ends = _running(F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: (F.length(b) + F.length(m)).cast("long")))
    both = F.arrays_zip(found.alias("text"), inside.alias("group"), ends.alias("end"))
    return F.transform(both, lambda m: F.struct((m["end"] - F.length(m["text"])).alias("start"), m["end"].alias("end"), m["text"].alias("text"), m["group"].alias("group")))


def _none() -> Column:
    return F.array().cast(_SPAN)


def _spans(text: Column, kind: Kind, order: int) -> Column:
    """Spans of one kind; patterns run only over texts that pass the kind's hint."""
    good = F.filter(occurrences(text, kind.pattern, kind.group), lambda m: F.length(m["group"]) >= kind.least)
    made = F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(kind.name).alias("kind"), m["text"].alias("text")))
    hint = text.rlike(kind.hint) if kind.hint != "AKIA" else text.contains(kind.hint)
    return F.when(hint, made).otherwise(_none())


def scan_secrets(docs: DataFrame, model: MarkovModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``base`` and ``added``, arrays of spans (start, order, end, kind, text) in the order of start and kind.

    ``base`` has the matches of KINDS. ``added`` has the strings of LEAST_RANDOM characters of the alphabet or more whose
    log-likelihood ratio reaches the model's cut, whether a base span covers them or not: where one does, it tells a
    value that was drawn from one that somebody wrote. Offsets are code points, ends are exclusive. A null text is empty and has no spans; whole texts are scanned, whatever their length; nothing is capped.
    Repeated rows are scanned alike. Other columns are ignored, whatever their names. An empty table gives an empty table.
    There is no shuffle.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumns({k.name: _spans(F.col("text"), k, i) for i, k in enumerate(KINDS)})
    string = "[A-Za-z0-9+/_=-]"
    candidate = Kind(RANDOM, f"(?<!{string}){string}{{{LEAST_RANDOM},}}", 0, LEAST_RANDOM, f"{string}{{{LEAST_RANDOM}}}")
    rows = rows.withColumn("strings", _spans(F.col("text"), candidate, len(KINDS)))
    rows = rows.select("doc", F.array_sort(F.concat(*[F.col(k.name) for k in KINDS])).alias("base"), "strings")
    likely = F.filter("strings", lambda s: log_likelihood_ratio(s["text"], model) >= model.cut)
    return rows.select(F.col("doc").alias(id_col), "base", F.when(F.size("strings") > 0, likely).otherwise(_none()).alias("added"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
