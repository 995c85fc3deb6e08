"""Facts, leaves and overlays of JSON documents, with VARIANT expressions; no JSON is parsed outside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions import score as S
from stratalog.operators.work import written

_FACT = "array<struct<category:string,key:string,value:string>>"


def kind(v: Column) -> Column:
    """Schema of a VARIANT: STRING, OBJECT<...>, ARRAY<...>, BIGINT, ..."""
    return F.schema_of_variant(v)


def part(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def string_of(v: Column) -> Column:
    """The value of a JSON string; null for anything else."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def whole_number_of(v: Column) -> Column:
    """A JSON number without its fraction; null for anything else, numbers in strings included."""
    return F.when(kind(v).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double").cast("long"))


def items(v: Column, path: str) -> Column:
    """The elements of an array as VARIANTs; empty where there is no array."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.expr("cast(array() as array<variant>)"))


def objects_of(v: Column, path: str = "$") -> Column:
    """The elements of an array that are objects; empty for anything but an array."""
    return F.filter(items(v, path), lambda x: kind(x).startswith("OBJECT"))


def first_array(v: Column, names: tuple[str, ...] = ("_data", "services", "endpoints")) -> Column:
    """The document itself if it is an array, else its first field of these names that is one; else empty."""
    return F.coalesce(*[F.try_variant_get(v, path, "array<variant>") for path in ("$", *[f"$.{n}" for n in names])], items(v, "$"))


def host_in(url: Column) -> Column:
    """What stands between ``://`` and the next ``/``, ``?`` or ``#``; the text itself where there is no such part."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.regexp_extract(rest, r"^([^/?#]+)", 1)
    return F.when(F.instr(url, "://") > 1, F.when(host == "", rest).otherwise(host)).otherwise(url)


def risk(v: Column) -> Column:
    """(score, level) by precedence: uwp_analyze.score, then security, then android_manifest.security_score; else null."""

    def found(score: str, level: str | None) -> Column:
        value = whole_number_of(part(v, score))
        named = F.nullif(string_of(part(v, level)), F.lit("")) if level else F.lit(None).cast("string")
        return F.when(value.isNotNull(), F.struct(value.alias("score"), F.coalesce(named, S.risk_level(value)).alias("level")))

    return F.coalesce(
        found("$.uwp_analyze.score.value", "$.uwp_analyze.score.level"),
        found("$.security.risk_score", "$.security.risk_level"),
        found("$.android_manifest.security_score", None),
    )


_LISTS = (
    "$.dependencies", "$.uwp_analyze.capabilities", "$.android_manifest.permissions", "$.urls", "$.endpoints", "$.network.endpoints",
    "$.certificates", "$.auth.providers", "$.auth.schemes",
)


def facts_of(v: Column, lists: dict[str, Column], scored: Column) -> Column:
    """Facts (category, key, value) of a document: framework, dep, capability, url, cert, risk and auth.

    ``lists`` has the array at each path of _LISTS as structs (text, object), ``scored`` the risk. Strings stand for
    themselves; of objects the name is the key and their JSON text the value. Elements without a name, and values of other
    kinds, are no facts.
    """
    fact = lambda c, k, x: F.struct(F.lit(c).alias("category"), k.alias("key"), x.alias("value"))
    text = lambda x, name: string_of(part(x, f"$.{name}"))
    filled = lambda x: F.nullif(x, F.lit(""))

    def strings(c: str, path: str, key=lambda s: s) -> Column:
        found = F.filter(lists[path], lambda x: filled(x["text"]).isNotNull())
        return F.transform(found, lambda x: fact(c, key(x["text"]), x["text"]))

    def objects(c: str, path: str, key, value=F.to_json) -> Column:
        found = F.filter(lists[path], lambda x: x["object"].isNotNull())
        return F.filter(F.transform(found, lambda x: fact(c, key(x["object"]), value(x["object"]))), lambda f: f.key.isNotNull())

    name = lambda x: filled(text(x, "name"))
    version = lambda x: F.coalesce(F.concat(text(x, "name"), F.lit("@"), filled(text(x, "version"))), F.to_json(x))
    spaced = lambda x: F.concat(F.coalesce(F.concat(filled(text(x, "namespace")), F.lit(":")), F.lit("")), name(x))
    print_of = lambda x: F.substr(F.coalesce(filled(text(x, "fingerprint")), filled(text(x, "subject"))), F.lit(1), F.lit(16))
    single = lambda c, k, x: F.when(x.isNotNull(), F.array(fact(c, F.lit(k), x))).otherwise(F.expr(f"cast(array() as {_FACT})"))
    parts = [
        single("framework", "name", filled(string_of(part(v, "$.framework")))),
        strings("dep", "$.dependencies"),
        objects("dep", "$.dependencies", name, version),
        objects("capability", "$.uwp_analyze.capabilities", spaced),
        strings("capability", "$.uwp_analyze.capabilities"),
        strings("capability", "$.android_manifest.permissions"),
        *[strings("url", path, host_in) for path in ("$.urls", "$.endpoints", "$.network.endpoints")],
        objects("cert", "$.certificates", print_of),
        single("risk", "risk-score", F.concat(scored.score.cast("string"), F.lit(":"), scored.level)),
        *[f for path in ("$.auth.providers", "$.auth.schemes") for f in (strings("auth", path), objects("auth", path, name))],
        single("auth", "scheme", filled(string_of(part(v, "$.security.auth")))),
    ]
    return F.concat(*[p.cast(_FACT) for p in parts])


def extract_facts(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, category, key, value) of every document; text that isn't JSON has no facts. No shuffle.

    A document is parsed once, each of its arrays is read once, and the kind of an element is told once: each in a
    projection of its own, which the facts then share.
    """
    parsed = rows.select(F.col(id_col).alias("id of it"), F.try_parse_json(F.col(json_col)).alias("v"))
    names = {path: f"list{i}" for i, path in enumerate(_LISTS)}
    read = parsed.select("id of it", "v", risk(F.col("v")).alias("scored"), *[items(F.col("v"), path).alias(n) for path, n in names.items()])
    told = lambda x: F.struct(string_of(x).alias("text"), F.when(kind(x).startswith("OBJECT"), x).alias("object"))
    read = read.select("id of it", "v", "scored", *[F.transform(n, told).alias(n) for n in names.values()])
    found = read.select("id of it", F.explode(facts_of(F.col("v"), {path: F.col(n) for path, n in names.items()}, F.col("scored"))).alias("f"))
    return found.select(F.col("id of it").alias(id_col), "f.category", "f.key", "f.value")


def pieces(rows: DataFrame, id_col: str, json_col: str, most: int = 0) -> DataFrame:
    """(id, path, value): objects are taken apart until their JSON text has at most ``most`` characters.

    Names of a path are joined by `` > ``; the document itself is ``(root)``. Arrays stay whole. With ``most`` 0 these are
    the leaves. One narrow step a level of nesting, as many as the documents need; an empty object is a leaf. What is open
    after a step is written, so a step reads its own level alone.
    """
    level = rows.select(id_col, F.lit("").alias("path"), F.try_parse_json(F.col(json_col)).alias("v")).where("v IS NOT NULL")
    out = None
    while True:
        nested = kind(F.col("v")).startswith("OBJECT<") & (kind(F.col("v")) != "OBJECT<>") & (F.length(F.to_json("v")) > most)
        named = F.when(F.col("path") == "", "(root)").otherwise(F.col("path"))
        done = level.where(~nested).select(id_col, named.alias("path"), F.to_json("v").alias("value"))
        out = done if out is None else out.unionByName(done)
        inner = F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("k", "v")
        deeper = level.where(nested).select(id_col, "path", inner)
        level = written(deeper.select(id_col, F.concat_ws(" > ", F.nullif("path", F.lit("")), "k").alias("path"), "v"), "pieces")
        if level.isEmpty():
            return out


def overlay_leaves(static: DataFrame, live: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Leaves of both documents of an id: value (live over static), provenance, and the static value that lost."""
    s = pieces(static, id_col, json_col).withColumnRenamed("value", "static")
    x = pieces(live, id_col, json_col).withColumnRenamed("value", "live")
    both = s.join(x, [id_col, "path"], "full_outer")
    source = F.when(F.col("live").isNull(), "static").when(F.col("static").isNull(), "live").otherwise("both")
    lost = F.when(F.col("live").isNotNull() & (F.col("live") != F.col("static")), F.col("static"))
    return both.select(id_col, "path", F.coalesce("live", "static").alias("value"), source.alias("provenance"), lost.alias("static_value"))


def same_json(a: Column, b: Column) -> Column:
    """Whether two texts are one document: fields in any order, white space aside. False where one isn't JSON."""
    text = lambda x: F.to_json(F.try_parse_json(x))
    return F.coalesce(text(a) == text(b), F.lit(False))
