"""Exports: the tables that belong to some applications as JSON lines in canonical order, with a checksum over all."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.operators.work import running, written

#: Rows, and then digests, that one digest is made of.
FAN = 1000
MANIFEST_VERSION = 2


def closure(tables: dict[str, DataFrame], apps: DataFrame, latest_only: bool = False) -> dict[str, DataFrame]:
    """The nine tables of an export, each with the rows that belong to ``apps`` (kb_id); aliases stand for their application.

    Tables: kb_apps (kb_id), kb_aliases (alias_kb_id, canonical_kb_id), knowledge_sources (id, kb_id, epoch), module_app_refs
    (source_id, body_sha256), modules (body_sha256), file_app_refs (source_id, file_sha256), files (file_sha256), app_facts
    (app: a kb_id), kb_diffs (from_source_id, to_source_id). ``latest_only`` takes each application's newest snapshot.
    """
    names = tables["kb_aliases"].select(F.col("alias_kb_id").alias("kb_id"), F.col("canonical_kb_id").alias("of"))
    wanted = apps.select("kb_id").join(names, "kb_id", "left").select(F.coalesce("of", "kb_id").alias("kb_id")).distinct()
    sources = tables["knowledge_sources"].join(wanted, "kb_id", "left_semi")
    if latest_only:
        newest = sources.groupBy("kb_id").agg(F.max_by("id", F.struct("epoch", "id")).alias("id"))
        sources = sources.join(newest.select("id"), "id", "left_semi")
    chosen = sources.select(F.col("id").alias("source_id"))
    refs = {n: tables[n].join(chosen, "source_id", "left_semi") for n in ("module_app_refs", "file_app_refs")}
    diffs = tables["kb_diffs"]
    for end in ("from_source_id", "to_source_id"):
        diffs = diffs.join(chosen.select(F.col("source_id").alias(end)), end, "left_semi")
    return {
        "kb_apps": tables["kb_apps"].join(wanted, "kb_id", "left_semi"),
        "kb_aliases": tables["kb_aliases"].join(wanted.select(F.col("kb_id").alias("canonical_kb_id")), "canonical_kb_id", "left_semi"),
        "knowledge_sources": sources,
        "module_app_refs": refs["module_app_refs"],
        "modules": tables["modules"].join(refs["module_app_refs"].select("body_sha256"), "body_sha256", "left_semi"),
        "file_app_refs": refs["file_app_refs"],
        "files": tables["files"].join(refs["file_app_refs"].select("file_sha256"), "file_sha256", "left_semi"),
        "app_facts": tables["app_facts"].join(wanted.select(F.col("kb_id").alias("app")), "app", "left_semi"),
        "kb_diffs": diffs,
    }


def canonical_line(columns: Sequence[str]) -> Column:
    """A row as JSON with its fields sorted by name, nulls too."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"})


def tree_digest(lines: DataFrame, line: str) -> tuple[str, int]:
    """SHA-256 over the ordered lines (rank from 0) by a tree, and their number; no task digests more than FAN values.

    The digest of a line, then of every FAN digests in a row as text, until one is left; of no lines, of the empty text.
    """
    level, n, depth = lines.select("rank", F.sha2(line, 256).alias("digest")), lines.count(), 0
    rows = n
    while n > 1:
        run = level.groupBy(F.expr(f"rank div {FAN}").alias("up")).agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("ds"))
        level = written(run.select(F.col("up").alias("rank"), F.sha2(F.array_join("ds.digest", ""), 256).alias("digest")), f"digests{depth}")
        n, depth = -(-n // FAN), depth + 1
    top = level.first()
    return (top.digest if top else hashlib.sha256(b"").hexdigest()), rows


def bundle_checksum(digests: dict[str, str]) -> str:
    """SHA-256 over ``name:digest`` lines in the order of names."""
    return hashlib.sha256("".join(f"{n}:{d}\n" for n, d in sorted(digests.items())).encode()).hexdigest()


def write_bundle(tables: dict[str, DataFrame], orders: dict[str, Sequence[str]], path: str, about: dict[str, str] | None = None) -> dict:
    """Write each table below ``path`` as JSON lines in the order of its columns, then ``manifest.json``; returns the manifest.

    Rows equal in the order's columns are ordered by their line, so the files of a table, one after the other, are the
    same bytes whatever the partitions. The manifest has counts and digests of the tables and one checksum, and is
    written last: a bundle without it is not whole.
    """
    counts, digests, spark = {}, {}, None
    for name, df in sorted(tables.items()):
        spark = df.sparkSession
        order = [F.col(c).alias(f"by {i}") for i, c in enumerate(orders[name])]
        lines = df.select(*order, canonical_line(df.columns).alias("line"))
        ranked = running(written(lines, f"lines_{name}"), [f"by {i}" for i in range(len(order))] + ["line"])
        place = ranked.repartitionByRange("rank").sortWithinPartitions("rank")
        place.select(F.col("line").alias("value")).write.text(f"{path}/{name}")
        digests[name], counts[name] = tree_digest(ranked, "line")
    manifest = {"version": MANIFEST_VERSION, **(about or {}), "counts": counts, "digests": digests, "checksum": bundle_checksum(digests)}
    text = json.dumps(manifest, sort_keys=True, indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/manifest.json")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0])


def read_bundle(spark: SparkSession, path: str, schemas: dict[str, str], orders: dict[str, Sequence[str]]) -> dict[str, DataFrame]:
    """The tables of a bundle, once their digests are those of its manifest; else ValueError."""
    manifest = read_manifest(spark, path)
    if manifest["checksum"] != bundle_checksum(manifest["digests"]):
        raise ValueError("the checksum is not that of the digests")
    out = {}
    for name in manifest["digests"]:
        df = spark.read.schema(schemas[name]).json(f"{path}/{name}")
        order = [F.col(c).alias(f"by {i}") for i, c in enumerate(orders[name])]
        lines = spark.read.text(f"{path}/{name}").select(F.from_json("value", schemas[name]).alias("r"), F.col("value").alias("line")).select("r.*", "line").select(*order, "line")
        ranked = running(written(lines, f"lines_{name}"), [f"by {i}" for i in range(len(order))] + ["line"])
        if tree_digest(ranked, "line") != (manifest["digests"][name], manifest["counts"][name]):
            raise ValueError(f"table {name} is not what was exported")
        out[name] = df
    return out


# Files of a knowledge folder, the section that must be there, what they hold, and whether an empty one is left out.
SECTIONS = (
    ("knowledge.json", "$", "$", False),
    ("communication/endpoints.json", "$.communication", "$.communication.endpoints", False),
    ("auth/methods.json", "$.auth", "$.auth.methods", False),
    ("ui/framework.json", "$.ui", "$.ui", False),
    ("ui/routes.json", "$.ui", "$.ui.routes", False),
    ("ipc/channels.json", "$.ipc", "$.ipc.channels", False),
    ("security/config.json", "$.security", "$.security.settings", False),
    ("stealth/features.json", "$.stealth", "$.stealth", False),
    ("telemetry/services.json", "$.telemetry", "$.telemetry.services", False),
    ("npm/metadata.json", "$.npm", "$.npm", False),
    ("npm/api-calls.json", "$.npm", "$.npm.network_calls", True),
    ("android/secrets.json", "$.android", "$.android.secrets", True),
    ("android/native-libs.json", "$.android", "$.android.native_libs", True),
    ("gobinary/metadata.json", "$.go_binary", "$.go_binary", False),
    ("packaging/metadata.json", "$.packaging", "$.packaging", False),
)


def knowledge_files(docs: DataFrame, app: str, knowledge: str) -> DataFrame:
    """(app, file, content): the files of a knowledge folder, by the sections that a JSON document has.

    A section that is null or missing gives no file, a part that is missing ``null``. Text that isn't JSON gives none.
    Documents are parsed once; there is no shuffle. Reports in Markdown are left to callers.
    """
    parsed = docs.select(F.col(app).alias("app"), F.try_parse_json(F.col(knowledge)).alias("v")).where("v IS NOT NULL")
    part = lambda path: F.try_variant_get("v", path, "variant")
    there = lambda path: part(path).isNotNull() & ~F.is_variant_null(part(path)) if path != "$" else F.lit(True)
    filled = lambda path: ~F.coalesce(F.to_json(part(path)), F.lit("null")).isin("null", "[]", "{}")
    files = [
        F.when(there(section) & (filled(path) if skip else F.lit(True)), F.struct(F.lit(name).alias("file"), F.coalesce(F.to_json(part(path)), F.lit("null")).alias("content")))
        for name, section, path, skip in SECTIONS
    ]
    return parsed.select("app", F.explode(F.array_compact(F.array(*files))).alias("f")).select("app", "f.file", "f.content")


def write_knowledge(docs: DataFrame, app: str, knowledge: str, path: str) -> None:
    """Write the knowledge files below ``path``, a folder ``app=A/file=F`` for each, the slash of a file's name escaped.

    Rows are dealt by application and file, so that a folder is one file however many tasks there are.
    """
    files = knowledge_files(docs, app, knowledge)
    files.repartition("app", "file").write.partitionBy("app", "file").text(path)
