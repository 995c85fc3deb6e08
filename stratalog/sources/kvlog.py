"""Key-value logs: one JSON object a line, read by Spark's text reader, from any file system and with large files split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def key_value_log(spark: SparkSession, *paths: str) -> DataFrame:
    """origin (the file's name), key, value, sequence, type; lines that don't parse, or lack one of these but value, are skipped."""
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_name").alias("origin"), F.from_json("value", "key string, value string, sequence bigint, type string").alias("e"))
    return lines.select("origin", "e.*").where("key IS NOT NULL AND sequence IS NOT NULL AND type IS NOT NULL")
