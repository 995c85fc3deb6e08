"""Rule cascades and chunking of module bodies."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions import shapes as S
from stratalog.functions import text as X

# Keywords of topics.
TOPICS = {
    "sendmessage": "messaging", "message": "messaging", "chat": "messaging", "send": "messaging", "receive": "messaging",
    "msg": "messaging", "encrypt": "crypto", "decrypt": "crypto", "crypto": "crypto", "cipher": "crypto", "key": "crypto",
    "signal": "crypto", "media": "media", "video": "media", "audio": "media", "image": "media", "thumbnail": "media",
    "stream": "media", "presence": "presence", "typing": "presence", "online": "presence", "telemetry": "telemetry",
    "metric": "telemetry", "analytics": "telemetry", "log": "telemetry", "logger": "telemetry", "tracking": "telemetry",
    "storage": "storage", "cache": "storage", "indexeddb": "storage", "db": "storage", "persist": "storage",
    "blob": "storage", "auth": "auth", "login": "auth", "token": "auth", "session": "auth", "credential": "auth",
    "oauth": "auth", "react": "ui", "render": "ui", "component": "ui", "view": "ui", "dom": "ui", "window": "ui",
    "voip": "call", "ring": "call",
}
# Topics of known roles; others have none.
ROLES = {
    "send": "messaging", "receive": "messaging", "auth": "auth", "pair": "auth", "storage": "storage", "sync": "storage",
    "protocol": "messaging", "crypto": "crypto", "media": "media", "presence": "presence", "call": "call", "ui": "ui",
    "telemetry": "telemetry",
}
# What bundled third-party code carries, one tuple for each rule.
VENDORED_PATHS = ("node_modules/",)
VENDORED_BANNERS = ("/*!", "@license")
VENDORED_WRAPPERS = ("(function(global,factory)", 'typeofexports==="object"&&typeofmodule!=="undefined"', "typeofexports==='object'&&typeofmodule!=='undefined'")
VENDORED_THEMES = ('"tokenColors"',)
VENDORED_LIBRARIES = ("clerk.com", "Clerk: ", "@clerk/", "mermaid")
# Names of libraries that chunks are called by, alone or before a hyphen or a dot.
VENDORED_NAMES = (
    "react", "react-dom", "react-dom-client", "scheduler", "cytoscape", "d3", "rxjs", "mobx", "immer", "redux", "zod",
    "axios", "apollo", "graphql", "lodash", "moment", "dayjs", "tslib", "core-js", "regenerator-runtime", "bluebird",
    "firebase", "firebase-app", "firebase-auth", "firebase-storage", "firebase-firestore", "pdfjs", "pdf.js", "pdf.worker",
    "cff_parser", "monaco", "codemirror", "prismjs", "katex", "mermaid", "streamdown", "shiki", "vscode-oniguruma", "vscode-textmate",
)
#: Bytes below which a body says nothing.
LEAST_BODY = 256


def is_vendored_name(name: Column) -> Column:
    """A library's name, or one that goes on behind a hyphen or a dot; false for null."""
    known = "|".join(n.replace(".", r"\.") for n in VENDORED_NAMES)
    return F.coalesce(F.lower(F.trim(name)).rlike(f"^(?:{known})(?:[-.]|$)"), F.lit(False))


def is_vendored(body: Column, name: Column | None = None) -> Column:
    """Marks of bundled third-party code anywhere in the body, or its name; white space is ignored in module wrappers.

    White space is only taken out of bodies that hold a word of a wrapper.
    """
    plain = VENDORED_PATHS + VENDORED_BANNERS + VENDORED_THEMES + VENDORED_LIBRARIES
    wrapped = (body.contains("factory") | body.contains("exports")) & S.contains_any(S.squeezed(body), VENDORED_WRAPPERS)
    grammar = body.contains('"scopeName"') & (body.contains('"patterns"') | body.contains('"repository"'))
    scoped = body.contains("@") & body.rlike(S.SCOPED_IMPORT)
    found = S.contains_any(body, plain) | grammar | scoped | wrapped
    return found if name is None else is_vendored_name(name) | found


def topic(role: Column, tags: Column, summary: Column, deps: Column | None = None) -> Column:
    """The topic of the first keyword in tags, summary and dependencies, else that of a known role, else other."""
    parts = [F.coalesce(c, F.lit("")) for c in (tags, summary, deps) if c is not None]
    roles = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return X.first_keyword(F.concat_ws(" ", *parts), TOPICS, F.coalesce(F.try_element_at(roles, F.lower(F.trim(role))), F.lit("other")))


def triage(body: Column, name: Column | None = None, least: int = LEAST_BODY) -> Column:
    """SKIP for short, third-party or re-exporting bodies, STATIC_OK for icons, lazy bindings and fragments, else ENRICH."""
    skip = (F.octet_length(body) < least) | is_vendored(body, name) | S.is_reexport(body)
    static = S.is_icon(body) | S.is_lazy_binding(body) | S.is_fragment(body)
    return F.when(skip, "SKIP").when(static, "STATIC_OK").otherwise("ENRICH")


@dataclass(frozen=True)
class ComponentRule:
    """Fits where all given parts fit: patterns of path and name, and any of the keywords in the lower-cased text.

    Of two components the one with the lower priority number comes first. A rule without a part fits nothing.
    """

    component: str
    confidence: float
    priority: int
    keyword: str | Sequence[str] | None = None
    path: str | None = None
    name: str | None = None
    suppress: bool = False

    def fits(self, low: Column, path: Column | None, name: Column | None) -> Column:
        words = [self.keyword] if isinstance(self.keyword, str) else list(self.keyword or ())
        parts = [functools.reduce(operator.or_, [low.contains(w.lower()) for w in words])] if words else []
        parts += [path.rlike(self.path)] if self.path is not None else []
        parts += [name.rlike(self.name)] if self.name is not None else []
        return F.coalesce(functools.reduce(operator.and_, parts), F.lit(False)) if parts else F.lit(False)


def with_component(rows: DataFrame, rules: Sequence[ComponentRule], text: Column, path: Column | None = None, name: Column | None = None) -> DataFrame:
    """``rows`` with ``component`` and ``confidence`` of the best rule that fits.

    A suppressing rule that fits removes its component. Of the others the highest confidence wins, then the component's
    priority, then the rule that was given first. Where the two best are of different components and equal in both, the
    row is ambiguous: that, and no fit at all, give ``other`` with confidence 1.0.

    Confidence and priority are the rules' own, so rules are ordered once and for all; a row computes which of them fit,
    once, in a projection of its own, and looks for the first two. There is no join and no shuffle.
    """
    plain = sorted((r for r in rules if not r.suppress), key=lambda r: (-r.confidence, r.priority))
    gone = [r for r in rules if r.suppress]
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in ("component", "confidence")]
    given = {"low": F.lower(text), "path": F.lit(None).cast("string") if path is None else path, "name": F.lit(None).cast("string") if name is None else name}
    at = rows.select(F.struct(*kept).alias("row"), *[v.alias(k) for k, v in given.items()])
    fits = lambda r: r.fits(F.col("low"), F.col("path"), F.col("name"))
    hits = at.select("row", F.array(*[fits(r) for r in plain]).alias("hits"), F.array(F.lit(False), *[fits(r) for r in gone]).alias("gone"))
    if gone:
        of = {r.component: [i for i, g in enumerate(gone, 1) if g.component == r.component] for r in plain}
        free = lambda r: functools.reduce(operator.and_, [~F.get("gone", F.lit(i)) for i in of[r.component]], F.lit(True))
        hits = hits.select("row", F.array(*[F.get("hits", F.lit(i)) & free(r) for i, r in enumerate(plain)]).alias("hits"))
    first = hits.select("row", "hits", F.array_position("hits", True).alias("one"))
    size = max(len(plain), 1)
    rest = F.slice("hits", F.least(F.col("one") + 1, F.lit(size)).cast("int"), F.when(F.col("one") < size, size).otherwise(0))
    two = first.select("row", F.col("one").cast("int"), F.when(F.col("one") > 0, F.col("one") + F.nullif(F.array_position(rest, True), F.lit(0))).cast("int").alias("two"))
    rank = [sorted({(-r.confidence, r.priority) for r in plain}).index((-r.confidence, r.priority)) for r in plain]
    of_rule = lambda values, place: F.get(F.array(*[F.lit(v) for v in values]) if values else F.array(F.lit(None).cast("string")), F.col(place) - 1)
    names, sure = [r.component for r in plain], [float(r.confidence) for r in plain]
    tied = (of_rule(rank, "one") == of_rule(rank, "two")) & (of_rule(names, "one") != of_rule(names, "two"))
    clear = (F.col("one") > 0) & ~F.coalesce(tied, F.lit(False))
    return two.select(
        *[F.col("row")[c].alias(c) for c in rows.columns if c not in ("component", "confidence")],
        F.when(clear, of_rule(names, "one")).otherwise("other").alias("component"),
        F.when(clear, of_rule(sure, "one").cast("double")).otherwise(F.lit(1.0)).alias("confidence"),
    )


#: A rule table is read up to this number of rules.
MOST_RULES = 2000


def apply_rules(rows: DataFrame, rules: DataFrame, id_col: str, text: str) -> DataFrame:
    """``with_component`` by a table of rules (component, pattern, confidence, priority, suppress).

    The rules are read by the driver, MOST_RULES of them at most, and become expressions.
    """
    read = rules.select("component", "pattern", "confidence", "priority", "suppress").limit(MOST_RULES + 1).collect()
    if len(read) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    made = [ComponentRule(r.component, float(r.confidence), r.priority, keyword=r.pattern, suppress=r.suppress) for r in read]
    return with_component(rows.select(id_col, text), made, F.col(text)).select(id_col, "component", "confidence")


def shannon_entropy(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """Bits per character of each text; 0 for an empty or null one. Texts are counted where they are, in Arrow batches."""
    bits = F.pandas_udf(_bits, "double").asNondeterministic()  # so that it runs once
    return rows.select(id_col, bits(F.coalesce(F.col(text), F.lit(""))).alias("entropy"))


def _bits(texts: pd.Series) -> pd.Series:
    def of(text: str) -> float:
        counts = np.unique(np.frombuffer(text.encode("utf-32-le"), "<u4"), return_counts=True)[1]
        return float(np.log2(len(text)) - (counts * np.log2(counts)).sum() / len(text)) if text else 0.0

    return texts.map(of).astype("float64")


def postings(rows: DataFrame, key: str, value: str, block: int, name: str) -> DataFrame:
    """The values of each key in ascending order, as text in blocks of ``block`` possible numbers: no list grows with the key."""
    blocks = rows.groupBy(key, F.expr(f"{value} div {block}").alias("block")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(value)).alias("values"))
    return blocks.select(key, "block", "n", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias(name))


def code_chunks(rows: DataFrame, id_col: str, body: str, lines: int = 50, overlap: int = 5) -> DataFrame:
    """Windows of ``lines`` lines that overlap by ``overlap``: chunk number, first line (from 1), text. Null has none."""
    rows = rows.where(F.col(body).isNotNull())
    split = F.split(F.col(body), "\n")
    step = lines - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(split) - overlap - 1), F.lit(step))
    return rows.select(id_col, split.alias("all"), F.posexplode(starts).alias("chunk", "start")).select(
        id_col, "chunk", (F.col("start") + 1).alias("first_line"), F.array_join(F.slice("all", F.col("start") + 1, lines), "\n").alias("text")
    )


def source_chunks(rows: DataFrame, id_col: str, body: str, most: int = 4096, lines: int = 50, overlap: int = 5) -> DataFrame:
    """Chunks with titles: a body of at most ``most`` bytes whole as ``Source``, others as windows ``Lines a-b``."""
    small = rows.where(F.octet_length(F.col(body)) <= most).select(id_col, F.lit(0).alias("chunk"), F.lit("Source").alias("title"), F.col(body).alias("text"))
    large = code_chunks(rows.where(F.octet_length(F.col(body)) > most), id_col, body, lines, overlap)
    to = F.col("first_line") + F.size(F.split("text", "\n")) - 1
    return small.unionByName(large.select(id_col, "chunk", F.concat(F.lit("Lines "), "first_line", F.lit("-"), to).alias("title"), "text"))


def paragraphs(rows: DataFrame, id_col: str, body: str) -> DataFrame:
    """The lines of a body that have text, numbered from 0 among all lines."""
    return rows.select(id_col, F.posexplode(F.split(F.col(body), "\n")).alias("line", "text")).where(F.trim("text") != "")


def multiset_similarity(a: DataFrame, b: DataFrame, group: str, token: str) -> DataFrame:
    """Sum of smaller over sum of larger counts of each token, per group."""
    count = lambda df, n: df.groupBy(group, token).agg(F.count("*").alias(n))
    both = count(a, "n_a").join(count(b, "n_b"), [group, token], "full_outer").fillna(0, ["n_a", "n_b"])
    return both.groupBy(group).agg((F.sum(F.least("n_a", "n_b")) / F.sum(F.greatest("n_a", "n_b"))).alias("similarity"))


def markdown_sections(rows: DataFrame, id_col: str, body: str, levels: int = 4) -> DataFrame:
    """Sections of a Markdown body: number from 0, title (the path of headings, ``A > B``), text, and whether it has code.

    Headings of up to ``levels`` signs begin a section, which their line is part of; one ends all sections of its level and
    below. Text before the first heading is titled ``Intro``, and so is a section whose headings are blank. Blank edges
    are cut off, and sections that are blank are dropped. Code is a part between two fences. The stack of open headings is a
    running last value per level, so no row of Python is needed.
    """
    blank, shape = " \t\r\n\f\x0b", f"^(#{{1,{levels}}})[ \\t\\f\\r]+(.+)$"
    lines = rows.select(id_col, F.posexplode(F.split(F.col(body), "\n")).alias("i", "line"))
    level = F.length(F.regexp_extract("line", shape, 1))
    lines = lines.withColumn("level", F.when(level > 0, level)).withColumn("title", F.btrim(F.regexp_extract("line", shape, 2), F.lit(blank)))
    w = Window.partitionBy(id_col).orderBy("i")
    opened = {f"at{k}": F.last(F.when(F.col("level") == k, F.col("i")), ignorenulls=True).over(w) for k in range(1, levels + 1)}
    titles = {f"title{k}": F.last(F.when(F.col("level") == k, F.col("title")), ignorenulls=True).over(w) for k in range(1, levels + 1)}
    lines = lines.withColumns({**opened, **titles, "section": F.count("level").over(w)})
    parts = []
    for k in range(1, levels + 1):
        above = F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(f"at{j}", F.lit(-1)) for j in range(1, k)])
        parts.append(F.when(F.col(f"at{k}") > above, F.col(f"title{k}")))
    path = F.concat_ws(" > ", *parts)
    grouped = lines.withColumn("path", path).groupBy(id_col, "section").agg(F.first("path").alias("path"), F.sort_array(F.collect_list(F.struct("i", "line"))).alias("ls"))
    text = F.btrim(F.array_join(F.col("ls.line"), "\n"), F.lit(blank))
    filled = grouped.select(id_col, "section", F.when(F.col("path") == "", "Intro").otherwise(F.col("path")).alias("title"), text.alias("text")).where("text <> ''")
    number = F.row_number().over(Window.partitionBy(id_col).orderBy("section")) - 1
    return filled.select(id_col, number.alias("section"), "title", "text", F.col("text").rlike("(?s)```.*?```").alias("has_code"))
