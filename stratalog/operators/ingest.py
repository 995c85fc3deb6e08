"""Ingestion of snapshots as one unit: nine steps whose tables become visible together, and a rerun that changes nothing.

Each batch writes a folder ``batch=N`` of every table, and last of all a marker; readers see the folders of marked
batches alone. So a batch that died leaves nothing that is seen, and its rerun overwrites what it left. Tables are only
ever added to: readers take the latest of each key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.operators import changes, json_docs
from stratalog.operators.work import scratch, written

#: What a batch consists of. ``kind`` is snapshot (name: display name, value: knowledge as JSON), module (name, value: body)
#: or fact (category, name: key, value).
BATCH = "kb_id string, binary_sha256 string, captured_at long, kind string, category string, name string, value string"
_SCHEMAS = {
    "kb_apps": "kb_id string, display_name string, first_seen_at long, last_seen_at long",
    "knowledge_sources": "source_id string, kb_id string, binary_sha256 string, epoch int, captured_at long, risk_score long, risk_level string, depth_score int, modules_indexed long, bodies_indexed long",
    "module_bodies": "body_sha256 string, body string, body_size long",
    "modules": "kb_id string, body_sha256 string, name string, last_seen_at long",
    "module_app_refs": "source_id string, body_sha256 string",
    "app_facts": "kb_id string, epoch int, category string, key string, value string",
    "kb_diffs": "kb_id string, epoch int, category string, key string, old_value string, new_value string, change_type string",
}
#: Categories of facts that a snapshot's depth is measured by.
DEPTH = ("framework", "dep", "capability", "url", "cert", "risk", "auth")


@dataclass(frozen=True)
class Catalogue:
    """The tables below ``path``, a folder that all executors see."""

    spark: SparkSession
    path: str

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Marked batches."""
        path, fs = self._fs("_batches")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def mark(self, batch: int) -> None:
        path, fs = self._fs(f"_batches/{batch}")
        fs.create(path, False).close()  # fails if it is there: of two writers of one batch one wins

    def rows(self, table: str) -> DataFrame:
        """All rows of the marked batches, with ``batch``."""
        marked, schema = self.batches(), f"{_SCHEMAS[table]}, batch long"
        if not marked:
            return self.spark.createDataFrame([], schema)
        folders = [f"{self.path}/{table}/batch={b}" for b in marked]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*folders)

    def write(self, table: str, batch: int, df: DataFrame) -> DataFrame:
        """Write the batch's rows, over what a dead run of it left; what comes back is read from there."""
        folder = f"{self.path}/{table}/batch={batch}"
        df.select(*[c.split()[0] for c in _SCHEMAS[table].split(", ")]).write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(_SCHEMAS[table]).parquet(folder)

    def apps(self) -> DataFrame:
        """An application's name as first seen, its first and last time."""
        rows = self.rows("kb_apps").groupBy("kb_id")
        return rows.agg(F.min_by("display_name", "batch").alias("display_name"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))

    def modules(self) -> DataFrame:
        """A module for each application and content, under its first name, with its last time."""
        return self.rows("modules").groupBy("kb_id", "body_sha256").agg(F.min_by("name", "batch").alias("name"), F.max("last_seen_at").alias("last_seen_at"))

    def facts(self) -> DataFrame:
        """The facts of each application's latest epoch: older ones are pruned from view."""
        rows = self.rows("app_facts").drop("batch")
        latest = self.rows("knowledge_sources").groupBy(F.col("kb_id").alias("of")).agg(F.max("epoch").alias("last"))
        return rows.join(latest, (F.col("kb_id") == F.col("of")) & (F.col("epoch") == F.col("last"))).drop("of", "last")


def ingest(catalogue: Catalogue, rows: DataFrame, batch: int, depth: Sequence[str] = DEPTH) -> bool:
    """Take a batch (columns of BATCH) in; False, and nothing done, where it is marked already.

    Snapshots whose application and content hash are known, or come twice, are skipped with all that belongs to them. The
    rest get the next epochs of their application, in the order of their time; bodies that are known are not written
    again; facts are compared with those of the epoch before. All steps are joins and aggregations by key.
    """
    if batch in catalogue.batches():
        return False
    with scratch():
        _take(catalogue, rows.where("kb_id IS NOT NULL AND binary_sha256 IS NOT NULL"), batch, depth)
    catalogue.mark(batch)  # 9
    return True


def _take(catalogue: Catalogue, rows: DataFrame, batch: int, depth: Sequence[str]) -> None:
    """Steps 1 to 8. Heads and epochs are written once. Modules and facts are read once each and shuffled once, by snapshot,
    and what is counted by snapshot is counted there; contents are read a second time, and combined before a shuffle."""
    own = ["kb_id", "binary_sha256"]
    # 1: what is known. 2 to 4: applications and epochs.
    heads = rows.where("kind = 'snapshot'").groupBy(*own).agg(F.min("captured_at").alias("captured_at"), F.min(F.struct("captured_at", "name", "value")).alias("first"))
    heads = written(heads, "heads")
    seen = heads.groupBy("kb_id").agg(F.min("captured_at").alias("first_seen_at"), F.max("captured_at").alias("last_seen_at"), F.min_by("first.name", "captured_at").alias("display_name"))
    catalogue.write("kb_apps", batch, seen)
    known = catalogue.rows("knowledge_sources")
    fresh = heads.join(known.select(*own), own, "left_anti")
    last = known.groupBy("kb_id").agg(F.max("epoch").alias("last"))
    number = F.row_number().over(Window.partitionBy("kb_id").orderBy("captured_at", "binary_sha256"))
    epochs = fresh.withColumn("number", number).join(last, "kb_id", "left").withColumn("epoch", F.coalesce("last", F.lit(0)) + F.col("number"))
    source_id = F.substring(F.sha2(F.concat_ws("|", *own), 256), 1, 16)
    taken = epochs.select(source_id.alias("source_id"), *own, F.col("epoch").cast("int").alias("epoch"), "captured_at", F.col("first.name").alias("display_name"), F.col("first.value").alias("knowledge"))
    taken = written(taken, "taken")
    if taken.isEmpty():
        for table in ("module_bodies", "modules", "module_app_refs", "app_facts", "kb_diffs", "knowledge_sources"):
            catalogue.write(table, batch, catalogue.spark.createDataFrame([], _SCHEMAS[table]))
        return
    # 5, 6: bodies, modules and references; depth, risk and counts of each snapshot. Within an application, its id stands for a snapshot.
    # Digests are shuffled as bytes, half as long as their digits.
    of = ["kb_id", "sid"]
    inside = rows.select("kind", "kb_id", F.unhex(source_id).alias("sid"), "category", "name", "value")
    ours = taken.select("kb_id", F.unhex("source_id").alias("sid"), "epoch", F.col("captured_at").alias("at"))
    modules = inside.where("kind = 'module'").select(*of, "name", F.unhex(F.sha2("value", 256)).alias("sha"))
    modules = modules.join(ours.drop("epoch"), of).distinct()
    modules = modules.groupBy(*of, "at", "sha").agg(F.count("name").alias("names"), F.min(F.struct("name"))["name"].alias("name"))
    modules = written(modules, "modules")
    digits = lambda c: F.lower(F.hex(c))
    catalogue.write("module_app_refs", batch, modules.select(digits("sid").alias("source_id"), digits("sha").alias("body_sha256")))
    named = modules.groupBy("kb_id", "sha").agg(F.min_by("name", F.struct("at", "name")).alias("name"), F.max("at").alias("last_seen_at"))
    catalogue.write("modules", batch, named.select("kb_id", digits("sha").alias("body_sha256"), "name", "last_seen_at"))
    bodies = rows.where("kind = 'module'").groupBy(F.sha2("value", 256).alias("body_sha256")).agg(F.first("value").alias("body"))
    bodies = bodies.join(catalogue.rows("module_bodies").select("body_sha256"), "body_sha256", "left_anti")
    bodies = bodies.join(modules.select(digits("sha").alias("taken")).distinct(), F.col("body_sha256").eqNullSafe(F.col("taken")), "left_semi")
    catalogue.write("module_bodies", batch, bodies.withColumn("body_size", F.octet_length("body").cast("long")))
    facts = inside.where("kind = 'fact'").select(*of, "category", F.col("name").alias("key"), "value").join(ours.drop("at"), of)
    new = catalogue.write("app_facts", batch, facts.groupBy(*of, "epoch", "category", "key").agg(F.max("value").alias("value")))
    counts = modules.where("sha IS NOT NULL").groupBy(digits("sid").alias("source_id")).agg(F.sum("names").alias("modules_indexed"), F.count("sha").alias("bodies_indexed"))
    covered = new.where(F.col("category").isin(*depth)).groupBy("kb_id", "epoch").agg(F.size(F.collect_set("category")).alias("covered"))
    risk = json_docs.risk(F.try_parse_json("knowledge"))
    sources = taken.join(counts, "source_id", "left").join(covered, ["kb_id", "epoch"], "left").withColumn("risk", risk)
    sources = sources.withColumns({
        "risk_score": F.col("risk.score"), "risk_level": F.coalesce("risk.level", F.lit("unknown")), "depth_score": F.round(100 * F.coalesce("covered", F.lit(0)) / len(depth)).cast("int"),
        "modules_indexed": F.coalesce("modules_indexed", F.lit(0)), "bodies_indexed": F.coalesce("bodies_indexed", F.lit(0)),
    })
    catalogue.write("knowledge_sources", batch, sources)
    # 7, 8: what facts changed against the epoch before, the last known one for the first new one; one shuffle, by application.
    span = taken.groupBy("kb_id").agg(F.min("epoch").alias("from_epoch"), F.max("epoch").alias("last_epoch"))
    both = new.unionByName(catalogue.rows("app_facts").drop("batch")).join(span, "kb_id").where("epoch >= from_epoch - 1")
    catalogue.write("kb_diffs", batch, changes.epoch_changes(both, "kb_id", "epoch", ["category", "key"], "value", "from_epoch", "last_epoch"))


def ingest_stream(stream: DataFrame, path: str, checkpoint: str):
    """Ingest every micro-batch of a stream; after a crash Spark repeats the last one, which its number makes harmless."""
    return stream.writeStream.foreachBatch(lambda df, batch: ingest(Catalogue(df.sparkSession, path), df, batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
