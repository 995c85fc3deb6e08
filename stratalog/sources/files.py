"""Readers of files that carry catalogue data, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

USAGE_EVENT = "ts timestamp, session_id string, goal_id string, event_type string, payload map<string,string>"
CAPTURE_SESSION = "session string, events array<struct<seq:int,ts:timestamp,type:string,source:string,data:string>>"

# Leading bytes of file formats, as hexadecimal digits.
MAGIC = (
    ("504B0304", "zip"), ("7F454C46", "elf"), ("4D5A", "pe"), ("CAFEBABE", "class"), ("25504446", "pdf"), ("89504E47", "png"),
    ("53514C69746520666F726D6174203300", "sqlite"), ("1F8B", "gzip"), ("0061736D", "wasm"), ("6465780A", "dex"),
)


def file_type(content: Column) -> Column:
    """Format by leading bytes; text without a zero byte in the first 512, else binary; empty."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.when(F.length(content) == 0, "empty")
    for magic, name in MAGIC:
        out = out.when(head.startswith(magic), name)
    return out.when(F.instr(F.regexp_replace(F.hex(F.substring(content, 1, 512)), "(..)", "$1 "), "00 ") == 0, "text").otherwise("binary")


def directory(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files below a folder: path, size, type and content hash."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.select("path", F.col("length").alias("size"), file_type(F.col("content")).alias("type"), F.sha2("content", 256).alias("sha256"), "content")


def content_addressed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blobs, one for each hash under its first path, and references, one for each path."""
    blobs = files.groupBy("sha256").agg(F.min("path").alias("path"), F.first("size").alias("size"))
    return blobs, files.select("path", "sha256")


def usage_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of usage events; lines that don't parse are skipped."""
    return spark.read.schema(USAGE_EVENT).option("mode", "DROPMALFORMED").json(path)


def capture_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Capture files, one JSON document each, as a row per event in the order of time, then number."""
    sessions = spark.read.schema(CAPTURE_SESSION).json(path, multiLine=True)
    return sessions.select("session", F.explode("events").alias("e")).select("session", "e.*").orderBy("ts", "seq")


def har_entries(spark: SparkSession, path: str) -> DataFrame:
    """Requests of an HTTP archive: method, url, status."""
    schema = "log struct<entries:array<struct<request:struct<method:string,url:string>,response:struct<status:int>>>>"
    entries = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("log.entries").alias("e"))
    return entries.select(F.col("e.request.method").alias("method"), F.col("e.request.url").alias("url"), F.col("e.response.status").alias("status"))


def csv_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def json_trees(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files as text with their path; files that aren't JSON have a null tree."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("path", F.input_file_name())
    return files.select("path", F.expr("try_parse_json(value)").alias("tree"))


def registry(spark: SparkSession, path: str, overrides: str | None = None) -> DataFrame:
    """Registry entries, one JSON document a file: name (the file's, without its ending), tree and origin.

    A file of the folder ``overrides`` replaces the one of the same name, or adds one; files that aren't JSON are left out.
    """
    def load(folder: str, origin: str) -> DataFrame:
        trees = json_trees(spark, folder).where("tree IS NOT NULL")
        return trees.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name"), "tree", F.lit(origin).alias("origin"))

    base = load(path, "embedded")
    if overrides is None:
        return base
    own = load(overrides, "override")
    return own.unionByName(base.join(own.select("name"), "name", "left_anti"))


_MEAN, _COUNT = r"(?i)mean[^0-9\n]*([0-9]+(?:\.[0-9]+)?)\s*%", r"([0-9]+)\s*/\s*12"


def score_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """package_id, mean10 (tenths of a percent), dims_at_80 and source of score files: ``P_score.json`` where a package has one
    that can be read, else ``P-SCORECARD.md``, of which the first percentage behind ``mean`` and the first ``N/12`` count."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*{_score.json,-SCORECARD.md}").withColumn("file", F.col("_metadata.file_name"))
    doc = F.from_json("value", "package_id string, mean10 int, dims_at_80 int")
    name = F.regexp_extract("file", r"^(.*?)(?:_score\.json|-SCORECARD\.md)$", 1)
    of_json = files.where(F.col("file").endswith(".json")).select(doc.alias("d"), name.alias("n")).where("d.mean10 IS NOT NULL")
    of_json = of_json.select(F.coalesce("d.package_id", "n").alias("package_id"), "d.mean10", "d.dims_at_80", F.lit("json").alias("source"))
    mean = F.nullif(F.regexp_extract("value", _MEAN, 1), F.lit("")).cast("double")
    of_text = files.where(F.col("file").endswith(".md")).select(
        name.alias("package_id"), F.round(mean * 10).cast("int").alias("mean10"), F.nullif(F.regexp_extract("value", _COUNT, 1), F.lit("")).cast("int").alias("dims_at_80"), F.lit("markdown").alias("source")
    )
    return of_json.unionByName(of_text.where("mean10 IS NOT NULL").join(of_json.select("package_id"), "package_id", "left_anti"))


def conditions_met(rules: DataFrame, condition: str, variables: dict[str, str], paths: DataFrame) -> DataFrame:
    """``rules`` whose condition holds: ``file_exists:P`` and ``dir_exists:P`` against a table of paths (path, of files), with
    ``${NAME}`` replaced; an empty, null or unknown condition holds. A folder is what a file's path has above it."""
    text = F.coalesce(F.col(condition), F.lit(""))
    for name, value in variables.items():
        text = F.replace(text, F.lit("${" + name + "}"), F.lit(value))
    asked = rules.withColumn("asked for", F.regexp_replace(text, "/+$", ""))
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))
    folders = paths.where("path LIKE '%/%'").select(F.explode(above).alias("path")).distinct()
    there = paths.select(F.concat(F.lit("file_exists:"), "path").alias("is there")).unionByName(folders.select(F.explode(F.array(F.concat(F.lit("file_exists:"), "path"), F.concat(F.lit("dir_exists:"), "path"))).alias("is there")))
    free = ~F.col("asked for").startswith("file_exists:") & ~F.col("asked for").startswith("dir_exists:")
    met = asked.join(there.distinct(), F.col("asked for") == F.col("is there"), "left")
    return met.where(free | F.col("is there").isNotNull()).drop("asked for", "is there")
