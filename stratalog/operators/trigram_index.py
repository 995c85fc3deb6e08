"""An index of trigrams: searches read the posting lists of a few rare trigrams instead of all texts.

Two tables lie below ``path``, both dealt into folders by a hash of the trigram and ordered by it within files: ``postings``
(gram, id, n: the number of trigrams of the row) and ``grams`` (gram, rows that have it). A lookup names its trigrams as
literals, so folders are pruned and within them row groups that hold none of these.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import text as X


@dataclass(frozen=True)
class TrigramIndex:
    """Where an index lies, in how many folders, and the type of its ids."""

    path: str
    folders: int
    id_type: str

    def _read(self, spark: SparkSession, name: str, columns: str) -> DataFrame:
        return spark.read.schema(f"{columns}, folder int").parquet(f"{self.path}/{name}")

    def postings(self, spark: SparkSession, grams: list[str]) -> DataFrame:
        """gram, id, n of the rows that have one of the trigrams; only their folders are listed."""
        return self._read(spark, "postings", f"gram string, id {self.id_type}, n int").where(self._named(spark, grams))

    def counts(self, spark: SparkSession, grams: list[str]) -> dict[str, int]:
        """How many rows have each of the trigrams: as many values as a query has trigrams."""
        found = {r.gram: r["rows"] for r in self._read(spark, "grams", "gram string, rows long").where(self._named(spark, grams)).select("gram", "rows").collect()}
        return {g: found.get(g, 0) for g in grams}

    def _named(self, spark: SparkSession, grams: list[str]) -> Column:
        if not grams:
            return F.lit(False)
        folders = spark.range(1).select(F.array(*[_folder(F.lit(g), self.folders) for g in grams]).alias("f")).first().f
        return F.col("folder").isin(sorted(set(folders))) & F.col("gram").isin(grams)


def _folder(gram: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(folders)).cast("int")


def build(rows: DataFrame, id_col: str, text: str, path: str, folders: int = 32) -> TrigramIndex:
    """Write the index of the rows' texts below ``path`` (a folder that all executors see). Null texts have no trigrams.

    One range shuffle by (folder, trigram, id): the list of a trigram that most rows have spans several files.
    """
    grams = rows.select(F.col(id_col).alias("id"), X.trigrams(F.col(text)).alias("g")).where("g IS NOT NULL")
    lists = grams.select(F.explode("g").alias("gram"), "id", F.size("g").alias("n")).withColumn("folder", _folder(F.col("gram"), folders))
    laid = lists.repartitionByRange("folder", "gram", "id").sortWithinPartitions("folder", "gram", "id")
    laid.write.partitionBy("folder").option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
    index = TrigramIndex(path, folders, dict(rows.dtypes)[id_col])
    counted = index._read(rows.sparkSession, "postings", f"gram string, id {index.id_type}, n int").groupBy("folder", "gram").agg(F.count("*").alias("rows"))
    counted.repartitionByRange("folder", "gram").sortWithinPartitions("folder", "gram").write.partitionBy("folder").parquet(f"{path}/grams")
    return index


def query_grams(spark: SparkSession, query: str) -> list[str]:
    return spark.range(1).select(X.trigrams(F.lit(query)).alias("g")).first().g


def needle_grams(needle: str) -> list[str]:
    """Trigrams that every text has which contains the needle, whatever stands around it.

    A word's blanks are only known where the needle itself ends the word; a fragment at an end of the needle may go on.
    """
    low, out = needle.lower(), []
    for m in re.finditer("[a-z0-9]+", low):
        word = m[0]
        if m.start() > 0:
            word = "  " + word
        if m.end() < len(low):
            word += " "
        out += [word[i : i + 3] for i in range(len(word) - 2)]
    return list(dict.fromkeys(out))


def similar_ids(index: TrigramIndex, spark: SparkSession, query: str, least: float) -> DataFrame:
    """``id`` of rows that can be similar to the query by ``least`` or more; no such row is missing.

    Such a row shares at least k = ceil(least * q) of the query's q trigrams, so it has one of the q - k + 1 rarest; and
    it has between least * q and q / least trigrams itself. Only the lists of these rarest ones are read.
    """
    grams = query_grams(spark, query)
    counts = index.counts(spark, grams)
    q, k = len(grams), max(1, math.ceil(least * len(grams) - 1e-9))
    rarest = sorted(grams, key=lambda g: (counts[g], g))[: q - k + 1]
    found = index.postings(spark, [g for g in rarest if counts[g]])
    sized = found.where((F.col("n") >= math.ceil(least * q - 1e-9)) & (F.col("n") <= math.floor(q / least + 1e-9))) if least > 0 else found
    return sized.select("id").distinct()


def containing_ids(index: TrigramIndex, spark: SparkSession, needle: str) -> DataFrame | None:
    """``id`` of rows that can contain the needle, from its two rarest lists; None where it has no whole trigram."""
    grams = needle_grams(needle)
    if not grams:
        return None
    counts = index.counts(spark, grams)
    rarest = sorted(grams, key=lambda g: (counts[g], g))[:2]
    if not counts[rarest[0]]:
        rarest = []
    found = index.postings(spark, rarest).groupBy("id").agg(F.count("*").alias("k"))
    return found.where(F.col("k") == len(rarest)).select("id")


def candidates(index: TrigramIndex, spark: SparkSession, query: str, least: float) -> DataFrame | None:
    """``id`` of all rows that ``search.ranked_search`` can find for a query; None where every row is to be looked at,
    as a needle without a whole trigram says nothing."""
    held = containing_ids(index, spark, query)
    if held is None or least <= 0:
        return None
    return similar_ids(index, spark, query, least).unionByName(held).distinct()
