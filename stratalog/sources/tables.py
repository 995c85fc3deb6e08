"""Catalogue tables as JSON lines in a fixed order; ``operators.export`` writes whole exports with a checksum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def export_jsonl(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """One JSON object a line with its fields sorted by name; files and lines in the given order."""
    fields = F.to_json(F.struct(*sorted(df.columns)))
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(fields.alias("value")).write.text(path)


def import_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
