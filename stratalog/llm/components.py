"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import forget, written


def _smallest(edges: DataFrame) -> DataFrame:
    """Of each node u the smallest of itself and its neighbours, m; combined before the shuffle.

    It is written, so that the join with it has a shuffle of its own on both sides: Spark then splits the edges of a hub.
    """
    return written(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "smallest")


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one edge, and no v is a u: one aggregation over the ends of the edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("u")), F.struct(F.col("v").alias("node"), F.lit(0).alias("u")))).alias("e"))
    counts = ends.groupBy("e.node").agg(F.sum("e.u").alias("n"), F.min("e.u").alias("least"))
    return counts.where("n > 1 OR (n = 1 AND least = 0)").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); the component is its smallest node.

    Alternates the large-star and small-star steps, which halve the depth of the trees, until only stars are left.
    Both steps join edges with one aggregated row per node. What a step gives is written, which cuts the lineage.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = _smallest(both)
        large = both.join(around, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "edges")
        below = _smallest(large)
        small = large.join(below, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        after = written(small.where("u <> v").distinct(), "edges")
        forget(edges, around, large, below)
        edges = after
        if _stars(edges):
            break
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
