"""Canonical form of script text: two minifications of one program get one hash.

A tokenizer is stateful, so this is the one text function that runs in Python, on Arrow batches.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of the language that keep their name.
RESERVED = frozenset(
    """break case catch class const continue debugger default delete do else export extends false finally for function if
    import in instanceof let new null return static super switch this throw true try typeof undefined var void while
    with yield async await of""".split()
)
_TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)"""
    r"""|(?P<name>(?<![\w$.])[A-Za-z_$][\w$]*)|(?P<member>\.[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<space>\s+)|(?P<other>.)""",
    re.DOTALL,
)
#: A longer text is hashed as it is.
LARGEST = 2_000_000


def canonical_text(text: str) -> str:
    """Without comments and white space between tokens, names replaced by numbers in the order they first occur."""
    if len(text) > LARGEST:
        return text
    names: dict[str, str] = {}
    out: list[str] = []
    for m in _TOKEN.finditer(text):
        kind, token = m.lastgroup, m[0]
        if kind in ("comment", "space"):
            continue
        if kind == "string":
            token = '"' + token[1:-1] + '"'
        elif kind == "name" and token not in RESERVED:
            token = names.setdefault(token, f"v{len(names)}")
        out.append(token)
    return " ".join(out)


def _hashes(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else hashlib.sha256(canonical_text(t).encode()).hexdigest())


def canonical_hash(text: Column) -> Column:
    return F.pandas_udf(_hashes, "string")(text)


def is_bypassed(text: Column) -> Column:
    """Whether a text is too large for its canonical form, so that its hash is that of the text as it is. False for null."""
    return F.coalesce(F.length(text) > LARGEST, F.lit(False))
