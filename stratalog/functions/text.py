"""Text expressions: search, similarity, names, URLs, rule ladders. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape_like(pattern: str) -> str:
    r"""Escape ``%``, ``_`` and ``\`` so that a pattern matches literally."""
    return pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_ci(text: Column, needle: str) -> Column:
    """Case-insensitive literal containment."""
    return text.ilike(f"%{escape_like(needle)}%")


def search_text(*columns: str) -> Column:
    """The searchable text of a module: its fields with a blank between, nulls empty. The body is no part of it."""
    parts: list[Column] = []
    for c in columns:
        parts += [F.coalesce(F.col(c), F.lit("")), F.lit(" ")]
    return F.concat(*parts[:-1])


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words of a text, each word padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of both; 0 if neither has any."""
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def snippet(text: Column, needle: str, before: int = 16, width: int = 64) -> Column:
    """``width`` characters from ``before`` characters ahead of the first match; from the start without a match."""
    at = F.instr(F.lower(text), needle.lower())
    return F.substr(text, F.greatest(F.lit(1), at - before), F.lit(width))


def snippet_around(text: Column, needle: str, width: int = 200) -> Column:
    """``width`` characters around the first match, which begins in their middle, line ends as blanks; at the text's end the
    last ones. Without a match the first ones as they are; empty for null."""
    text = F.coalesce(text, F.lit(""))
    at = F.instr(F.lower(text), needle.lower()) - 1
    start = F.greatest(at - width // 2, F.lit(0))
    start = F.when(start + width > F.length(text), F.greatest(F.length(text) - width, F.lit(0))).otherwise(start)
    return F.when(at < 0, F.substr(text, F.lit(1), F.lit(width))).otherwise(F.translate(F.substr(text, (start + 1).cast("int"), F.lit(width)), "\n", " "))


def slug(text: Column) -> Column:
    """Lower case, other characters than letters and digits as single hyphens, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def fingerprint(*parts: Column, length: int = 16) -> Column:
    """The first hexadecimal digits of the SHA-256 of the parts joined by ``|``."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


_BLANK = " \t\r\n\f\x0b"
# Names that only hold a place.
PLACEHOLDER_NAME = r"^teams_module_[0-9]+\z"


def _trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANK))


def display_name(name: Column, synthetic: Column) -> Column:
    """The synthetic name, without blanks around it, where there is one and the name only holds a place."""
    return F.when((_trimmed(synthetic) != "") & name.rlike(PLACEHOLDER_NAME), _trimmed(synthetic)).otherwise(name)


def summary_line(summary: Column, role: Column, tags: Column) -> Column:
    """``[role] summary {tags}``, each part without blanks around it, and role and tags only where they are there."""
    head = F.when(_trimmed(role) != "", F.concat(F.lit("["), _trimmed(role), F.lit("] "))).otherwise(F.lit(""))
    tail = F.when(_trimmed(tags) != "", F.concat(F.lit(" {"), _trimmed(tags), F.lit("}"))).otherwise(F.lit(""))
    return F.concat(head, _trimmed(summary), tail)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def first_keyword(text: Column, topics: Mapping[str, str], otherwise: Column) -> Column:
    """The topic of the first keyword, in sorted order, that the lower-cased text contains."""
    low, out = F.lower(text), None
    for word in sorted(topics):
        hit = low.contains(word)
        out = F.when(hit, topics[word]) if out is None else out.when(hit, topics[word])
    return out.otherwise(otherwise)


def first_match(text: Column, ladder: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first regular expression of the ladder that matches."""
    out = None
    for pattern, label in ladder:
        hit = text.rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


def capped_matches(text: Column, pattern: str, most: int) -> Column:
    """The first ``most`` distinct matches, in the order of the text."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), 1, most)


def error_class(message: Column) -> Column:
    has = message.contains
    return (
        F.when(has("context deadline") | has("timeout"), "timeout")
        .when(has("json") | has("unmarshal") | has("parse"), "json_parse")
        .when(has("prompt") & has("large"), "prompt_too_large")
        .when(has("5") & has("sampl"), "mcp_sampling_5xx")
        .otherwise("other")
    )


# Bytes below which nothing is minified, bytes that are looked at, the longest line from which a text is,
# and line ends a byte below which it is.
MINIFIED_LEAST, MINIFIED_SEEN, MINIFIED_LINE, MINIFIED_ENDS = 512, 1 << 16, 2000, 0.002


def looks_minified(text: Column) -> Column:
    """A very long line and few line ends among the bytes that are looked at. False for short texts and null."""
    head = F.decode(F.substring(F.encode(text, "UTF-8"), 1, MINIFIED_SEEN), "ISO-8859-1")  # a character a byte
    lines = F.split(head, "\n", -1)
    longest = F.array_max(F.transform(lines, lambda x: F.length(x)))
    sparse = (F.size(lines) - 1) / F.length(head) < MINIFIED_ENDS
    return F.coalesce((F.octet_length(text) >= MINIFIED_LEAST) & (longest >= MINIFIED_LINE) & sparse, F.lit(False))
