"""Scores: ladders of levels, relative changes, capped sums, quantiles by index, version deltas, CVSS."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(score: Column, steps: Sequence[tuple[float, str]], lowest: str) -> Column:
    """The name of the first step (from the top) whose bound the score reaches."""
    out = None
    for bound, name in sorted(steps, reverse=True):
        out = F.when(score >= bound, name) if out is None else out.when(score >= bound, name)
    return out.otherwise(lowest)


def risk_level(score: Column) -> Column:
    return ladder(score, ((25, "medium"), (50, "high"), (75, "critical")), "low")


def threat_level(score: Column) -> Column:
    return ladder(score, ((1, "LOW"), (40, "MEDIUM"), (100, "HIGH"), (200, "CRITICAL")), "CLEAN")


def relative_delta(recent: Column, baseline: Column, floor: float = 0.01) -> Column:
    return (recent - baseline) / F.greatest(baseline, F.lit(floor))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, 0 where whole is 0."""
    return F.coalesce(F.floor(F.try_divide(part * 100, whole)), F.lit(0)).cast("long")


def capped(x: Column, weight: int, most: int) -> Column:
    return F.least(x * weight, F.lit(most))


def index_quantile(sorted_values: Column, q: float) -> Column:
    """The element at index int(n * q) of a sorted array; no interpolation. Null for an empty array."""
    return F.get(sorted_values, F.least(F.floor(F.size(sorted_values) * q), F.size(sorted_values) - 1).cast("int"))


def semver(version: Column) -> Column:
    """Three numbers of a version, or null for a pre-release, build metadata or anything but numbers."""
    plain = F.regexp_replace(F.trim(version), "^v", "")
    number = lambda i: F.coalesce(F.try_element_at(F.split(plain, "\\."), F.lit(i)), F.lit("0")).cast("int")
    good = plain.rlike(r"^[0-9]+(\.[0-9]+)?(\.[0-9]+)?(\.[^+-]*)?$")
    return F.when(good, F.array(number(1), number(2), number(3)))


def outdated_by(declared: Column, latest: Column) -> Column:
    """(major, minor, patch) that ``latest`` is ahead; parts below the first difference are 0; null if not ahead."""
    d, x = semver(declared), semver(latest)
    major, minor, patch = (F.greatest(F.get(x, i) - F.get(d, i), F.lit(0)) for i in range(3))
    ahead = d.isNotNull() & x.isNotNull() & (major + minor + patch > 0)
    return F.when(
        ahead,
        F.struct(
            major.alias("major"),
            F.when(major > 0, 0).otherwise(minor).alias("minor"),
            F.when((major > 0) | (minor > 0), 0).otherwise(patch).alias("patch"),
        ),
    )


def cvss3_base_score(vector: Column) -> Column:
    """Base score of a CVSS v3 vector by the published formula; an unknown or missing metric weighs 0. Null for null."""
    m = F.str_to_map(vector, F.lit("/"), F.lit(":"))

    def metric(name: str, values: dict[str, float]) -> Column:
        out = None
        for key, value in values.items():
            hit = m[name] == key
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return out.otherwise(0.0)

    # Weights and formula of the published standard.
    impact3 = {"H": 0.56, "L": 0.22, "N": 0.0}
    wide = F.coalesce(m["S"] == "C", F.lit(False))
    c, i, a = (metric(x, impact3) for x in "CIA")
    iss = 1 - (1 - c) * (1 - i) * (1 - a)
    impact = F.when(wide, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, 15)).otherwise(6.42 * iss)
    rights = F.when(wide, metric("PR", {"N": 0.85, "L": 0.68, "H": 0.5})).otherwise(metric("PR", {"N": 0.85, "L": 0.62, "H": 0.27}))
    reach = metric("AV", {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2})
    ease = 8.22 * reach * metric("AC", {"L": 0.77, "H": 0.44}) * rights * metric("UI", {"N": 0.85, "R": 0.62})
    total = F.when(wide, 1.08 * (impact + ease)).otherwise(impact + ease)
    return F.when(vector.isNull(), None).when(impact <= 0, 0.0).otherwise(F.ceil(F.round(F.least(total, F.lit(10.0)) * 10, 6)) / 10)


def cvss_level(score: Column) -> Column:
    return ladder(score, ((0.1, "low"), (4.0, "medium"), (7.0, "high"), (9.0, "critical")), "none")


def hamming_severity(distance: Column, passes: int = 5, flags: int = 12) -> Column:
    return F.when(distance <= passes, "PASS").when(distance <= flags, "FLAG").otherwise("BLOCK")


def coverage(probes: Sequence[tuple[str, Column]]) -> tuple[Column, Column]:
    """Names of the probes that hold and of those that don't, in their order; null doesn't hold."""
    held = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in probes]))
    gone = F.array_compact(F.array(*[F.when(F.coalesce(~hit, F.lit(True)), F.lit(name)) for name, hit in probes]))
    return held, gone


# Keywords, which are no names of functions or classes, and what a class of characters looks like.
KEYWORDS = (
    "return", "switch", "if", "for", "while", "catch", "throw", "var", "let", "const", "function", "class", "import",
    "export", "default", "new", "delete", "typeof", "instanceof", "void", "break", "continue", "case", "else", "try", "do",
    "in", "of", "yield", "async", "await", "func", "package", "type", "struct", "interface", "map", "chan", "go", "defer",
    "select", "range",
)
CHARACTER_CLASS = r"^\[[\^]?[A-Za-z0-9\\.\-_^$|?*+(){}\[\]]{1,20}\]$"
NAME_KINDS = ("methods", "functions", "classes", "types")


def is_noise(symbols: Column) -> Column:
    """Whether a JSON object of lists of symbols says nothing: blank, no object, without fields, all fields empty lists, a
    keyword for a name, or a class of characters (``[a-z]``) in any list.

    Fields that are no list of strings (nulls in it count as empty strings, null is an empty list) are no noise, and say
    that there is something.
    """
    fields = F.map_entries(F.try_variant_get(F.try_parse_json(symbols), "$", "map<string,variant>"))
    kind = lambda e: F.schema_of_variant(e["value"])
    a_list = lambda e: kind(e).isin("ARRAY<STRING>", "ARRAY<VOID>", "VOID")
    strings = lambda e: F.coalesce(F.try_variant_get(e["value"], "$", "array<string>"), F.array().cast("array<string>"))
    bad = lambda name, x: x.rlike(CHARACTER_CLASS) | (name.isin(*NAME_KINDS) & F.lower(x).isin(*KEYWORDS))
    telling = F.exists(fields, lambda e: a_list(e) & F.exists(strings(e), lambda x: F.coalesce(bad(e["key"], x), F.lit(False))))
    empty = F.forall(fields, lambda e: a_list(e) & (F.size(strings(e)) == 0))
    return F.coalesce(telling | empty, F.lit(True))


def diff_identifier(category: Column, name: Column) -> Column:
    """What identifies a change of a category: digests are cut to sixteen characters, a risk has one name."""
    return F.when(category == "risk", "risk-score").when(category.isin("cert", "module", "file"), F.substring(name, 1, 16)).otherwise(name)


def release_number(version: Column) -> Column:
    """A long in the order of release versions (``go1.21rc2``, ``1.20``, ``1.21.3-x``); -1 for what is none, below all others.

    What follows a hyphen doesn't count. Of one minor version betas come first, then candidates, then patches. A version
    without a patch is its patch 0 up to minor 20, and from 21 on comes before its betas.
    """
    plain = F.regexp_replace(F.regexp_replace(F.trim(version), "^go", ""), "-.*$", "")
    shape = r"^([0-9]{1,6})(?:\.([0-9]{1,6})(?:(beta|rc)([0-9]{1,6})|\.([0-9]{1,6}))?)?$"
    groups = F.when(plain.rlike(shape), F.split(F.regexp_replace(plain, shape, "$1,$2,$3,$4,$5"), ","))

    def number(g: Column) -> Column:
        part = lambda i: F.coalesce(F.nullif(g[i - 1], F.lit("")).cast("long"), F.lit(0))
        later = (part(1) > 1) | (part(2) > 20)
        kind = F.when(g[2] == "beta", 1).when(g[2] == "rc", 2).when((g[4] == "") & later, 0).otherwise(3)
        return ((part(1) * 1_000_000 + part(2)) * 4 + kind) * 1_000_000 + F.when(g[2] != "", part(4)).otherwise(part(5))

    # A lambda names the groups, so that the version is matched once.
    return F.coalesce(F.transform(F.array(groups), lambda g: F.when(g.isNotNull(), number(g)))[0], F.lit(-1)).cast("long")
