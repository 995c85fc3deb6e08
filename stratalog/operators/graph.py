"""Graphs in edge tables: components, reachability, levels, names resolved to ids."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_names(edges: DataFrame, nodes: DataFrame, group: str, name: str, id_col: str) -> DataFrame:
    """``to_id`` of each edge: the smallest id of that name within the edge's group, null if there is none."""
    ids = nodes.groupBy(group, name).agg(F.min(id_col).alias("to_id"))
    return edges.join(ids, [group, name], "left")


def resolve_aliases(ids: DataFrame, aliases: DataFrame, id_col: str, alias: str, canonical: str) -> DataFrame:
    """One hop from alias to canonical id; an id without an alias is its own.

    Chains are refused: an alias whose canonical id is an alias itself resolves nothing.
    """
    whole = aliases.join(aliases.select(F.col(alias).alias(canonical)).distinct(), canonical, "left_anti")
    found = ids.join(whole.select(F.col(alias).alias(id_col), F.col(canonical).alias("found")), id_col, "left")
    return found.withColumn("canonical", F.coalesce("found", id_col)).drop("found")


def include_edges(files: DataFrame, file: str, body: str) -> DataFrame:
    """(src, name, dst): quoted names that files include or import, and the file of that name; null where there is none."""
    pattern = r"""(?m)^\s*(?:#\s*include|from|import)\s+["']?([\w./-]+)["']?"""
    named = files.select(F.col(file).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)))).alias("name"))
    return named.join(files.select(F.col(file).alias("name"), F.col(file).alias("dst")).distinct(), "name", "left")


def _checkpoint_dir(spark) -> None:
    """Checkpoints go to the folder of spark.checkpoint.dir; only a single machine may use one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="stratalog-"))


def leaf_first_levels(edges: DataFrame) -> DataFrame:
    """(node, level): leaves (nodes without outgoing edges) are 0, others one above their highest target.

    One round a level, as many as there are; nodes on or before a cycle never become ready and get null. A round keeps
    only the nodes that aren't ready yet, each with its number of open edges and its level so far: what became ready in
    the last round is taken from these. So its work is the edges into new nodes, and one checkpoint cuts its lineage.
    """
    _checkpoint_dir(edges.sparkSession)
    edges = edges.select("src", "dst").distinct()
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    waiting = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("open"), F.lit(0).alias("level"))
    ready = nodes.join(waiting, "node", "left_anti").withColumn("level", F.lit(0)).checkpoint()
    waiting, done = waiting.checkpoint(), ready
    while not ready.isEmpty():
        met = edges.join(ready.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"))
        met = met.agg(F.count("*").alias("met"), (F.max("level") + 1).alias("reached"))
        waiting = waiting.join(met, "node", "left").select(
            "node", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open"), F.greatest("level", F.coalesce("reached", F.lit(0))).alias("level")
        )
        waiting = waiting.checkpoint()
        ready = waiting.where("open = 0").select("node", "level")
        waiting = waiting.where("open > 0")
        done = done.unionByName(ready)
    return nodes.join(done, "node", "left")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components of (src, dst) by colouring; the component is its smallest node.

    Each pass spreads the smallest node forward until nothing changes and keeps the nodes that also reach back to it. A
    pass settles every component that holds the smallest node of its colour; the others go on with what is left.
    """
    _checkpoint_dir(edges.sparkSession)
    left = edges.select("src", "dst").distinct().checkpoint()
    nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().checkpoint()
    done = None
    while True:
        colour = _spread(nodes.withColumn("c", F.col("node")), left)
        same = left.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst")
        same = same.where("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cs")
        back = _reach(colour.where("node = c"), same)
        done = back if done is None else done.unionByName(back)
        nodes = nodes.join(back, "node", "left_anti").checkpoint()
        if nodes.isEmpty():
            return done.withColumnRenamed("c", "component")
        left = left.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").checkpoint()


def _spread(colour: DataFrame, edges: DataFrame) -> DataFrame:
    """The smallest colour that reaches each node along the edges."""
    while True:
        given = edges.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("g"))
        after = colour.join(given, "node", "left").select("node", F.least("c", F.coalesce("g", "c")).alias("c"), (F.col("g") < F.col("c")).alias("moved")).checkpoint()
        colour = after.select("node", "c")
        if after.where("moved").isEmpty():
            return colour


def _reach(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, c) of all nodes that roots (node, c) reach along edges (src, dst, cs) of their colour."""
    found = fresh = roots.select("node", "c").checkpoint()
    while not fresh.isEmpty():
        step = edges.join(fresh.withColumnRenamed("node", "src"), "src").where("cs = c").select(F.col("dst").alias("node"), "c").distinct()
        fresh = step.join(found, ["node", "c"], "left_anti").checkpoint()
        found = found.unionByName(fresh)
    return found


def collapsed_levels(edges: DataFrame) -> DataFrame:
    """(node, component, level): cycles collapsed to one unit, then leaves first."""
    parts = components(edges)
    of = lambda n: parts.select(F.col("node").alias(n), F.col("component").alias(f"c_{n}"))
    units = edges.join(of("src"), "src").join(of("dst"), "dst").where("c_src <> c_dst").select(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).distinct()
    levels = leaf_first_levels(units)
    return parts.join(levels.withColumnRenamed("node", "component"), "component", "left").select("node", "component", F.coalesce("level", F.lit(0)).alias("level"))


def depth_sql(edges_view: str, root: str) -> str:
    """Recursive query: depth of every node below the roots."""
    return f"""
        WITH RECURSIVE tree(node, depth) AS (
            SELECT child, 0 FROM {edges_view} WHERE {root}
            UNION ALL SELECT e.child, t.depth + 1 FROM {edges_view} e JOIN tree t ON e.parent = t.node
        ) SELECT node, max(depth) AS depth FROM tree GROUP BY node"""
