"""A manifest of a dataset as a forest of hash trees, with a proof for every row.

Rows of a group are the leaves of a tree, numbered from 0. A node carries the interval [lo, hi) of the leaf ranks that
it covers. At level k all intervals begin at multiples of fan^k, so ``lo div fan^k`` is the bucket of a node, and a node
lies below the one node of its parent's level that is in the same bucket and whose interval contains its own. What the
parent's interval has beside the node's, [parent.lo, lo) and [hi, parent.hi), are the siblings before and after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import running, spare_name, written

_STEP = "struct<before:string,after:string>"


def field_digest(*values: Column) -> Column:
    """SHA-256 of the values in a row: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value as text."""
    text = [v.cast("string") for v in values]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]
    return F.sha2(F.concat(*parts), 256)


def _levels(leaves: DataFrame, fan: int) -> list[DataFrame]:
    """The written nodes of level 1, 2, ...: tree, size (its leaves), lo, hi, digest, children (lo, hi, digest)."""
    largest = leaves.agg(F.max("size")).first()[0] or 0
    nodes, span, out = leaves, 1, []
    while span < largest:
        of = F.expr(f"lo div {span * fan}").alias("bucket")
        runs = nodes.where(F.col("size") > span).groupBy("tree", "size", of).agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))
        nodes = runs.select(
            "tree",
            "size",
            F.get("children", F.lit(0)).lo.alias("lo"),
            F.element_at("children", -1).hi.alias("hi"),
            F.sha2(F.array_join("children.digest", ""), 256).alias("digest"),
            "children",
        )
        nodes = written(nodes, f"level{len(out) + 1}")
        out.append(nodes)
        span *= fan
    return out


def _difference(lo: str, hi: str) -> Column:
    """The digests of the parent's children within [lo, hi), as one text."""
    return F.array_join(F.transform(F.filter("children", lambda c: (c.lo >= F.col(lo)) & (c.hi <= F.col(hi))), lambda c: c.digest), "")


def _with_proofs(leaves: DataFrame, levels: Sequence[DataFrame], tops: DataFrame, fan: int, payload: Sequence[str] = ()) -> DataFrame:
    """tree, lo, digest and ``payload`` of the leaves, with ``top`` and ``proof``; ``tops`` (tree, above) has what lies above a tree's root.

    From the top down each level joins the one above it by bucket and containment: a node's proof is the difference of
    its parent's interval and its own, and then its parent's proof. No parent has more than ``fan`` partners, and a
    level has a ``fan``-th of the rows of the one below it.
    """
    parents = None
    for k in range(len(levels), -1, -1):
        span = fan**k
        nodes, more = (levels[k - 1], ["children"]) if k else (leaves, list(payload))
        roots = nodes.where(F.col("size") <= span) if k else nodes.where("size = 1")
        own = roots.join(tops, "tree").select("tree", "lo", "hi", "digest", *more, F.col("digest").alias("top"), F.col("above").alias("proof"))
        if parents is None:
            parents = own
            continue
        up = parents.select(
            F.col("tree").alias("of"), F.expr(f"lo div {span * fan}").alias("bucket"), F.col("lo").alias("from"), F.col("hi").alias("to"), "children", "top", F.col("proof").alias("above")
        )
        below = nodes.where(F.col("size") > span).withColumnRenamed("children", "grandchildren") if k else nodes.where("size > 1")
        contained = (F.col("tree") == F.col("of")) & (F.expr(f"lo div {span * fan}") == F.col("bucket")) & (F.col("from") <= F.col("lo")) & (F.col("hi") <= F.col("to"))
        step = F.struct(_difference("from", "lo").alias("before"), _difference("hi", "to").alias("after"))
        kept = [F.col("grandchildren").alias("children")] if k else list(payload)
        joined = below.join(up, contained).select("tree", "lo", "hi", "digest", *kept, "top", F.concat(F.array(step), "above").alias("proof"))
        parents = joined.unionByName(own)
    return parents


def merkle_manifest(rows: DataFrame, digest: str, group: str, order: Sequence[str], keep: Sequence[str] = (), fan: int = 8) -> DataFrame:
    """``keep`` of every row with its ``leaf`` digest, the ``subroot`` of its group, the ``root`` of all and its ``proof``.

    The leaves of a group are in the order of ``order``, nulls first, then of their digests (repeated rows are leaves of
    their own, and rows equal in both are interchangeable). While there is more than one node, every ``fan`` in a row,
    and what is left at the end, become the digest of their digests in a row. The roots of the groups, null first and
    then by their bytes, are the leaves of a last tree. ``proof`` has a step for each level up to ``root``: the digests of
    the siblings ``before`` and ``after``, each joined to one text; ``fold`` recomputes the root with it. ``digest`` must
    not be null; texts of any length or null are the caller's to digest. Names of columns don't matter, as long as none
    is kept twice. An empty table gives an empty table.

    Rows are range-sorted once to get their ranks and shuffled once by groups of ``fan``; levels shrink by ``fan``, and
    every join key has ``fan`` rows at most, so groups of any size and a group of a third of all rows make no hot task.
    """
    held = F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias(spare_name(keep)))
    order_by = [F.col(f"`{c}`").alias(f"by{i}") for i, c in enumerate(order)]
    flat = rows.select(held.alias("held"), F.col(f"`{group}`").alias("group"), *order_by, F.col(f"`{digest}`").alias("digest"))
    flat = written(flat, "leaves")  # bounds of ranges are drawn from it: the input is read and digested once
    ranked = running(flat, ["group", *[f"by{i}" for i in range(len(order))], "digest"])
    groups = ranked.groupBy("group").agg(F.min("rank").alias("first"), F.count("*").alias("size"))
    groups = written(running(groups, ["group"]).withColumnRenamed("rank", "tree"), "trees")
    trees = groups.select(F.col("group").alias("named"), "first", "size", "tree")
    leaves = ranked.join(trees, F.col("group").eqNullSafe(F.col("named")))
    leaves = leaves.select("tree", "size", (F.col("rank") - F.col("first")).alias("lo"), (F.col("rank") - F.col("first") + 1).alias("hi"), "digest", "held")
    bare = ["tree", "size", "lo", "hi", "digest"]
    levels = _levels(leaves.select(*bare), fan)
    # The last tree: its leaves are the groups' roots, in the order of the groups.
    roots = leaves.where("size = 1").select(*bare)
    for k, level in enumerate(levels, 1):
        roots = roots.unionByName(level.where(F.col("size") <= fan**k).select(*bare))
    count = groups.count()
    last = roots.select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("size"), F.col("tree").alias("lo"), (F.col("tree") + 1).alias("hi"), "digest")
    last = written(last, "roots")
    upper = _levels(last, fan)
    nothing = last.sparkSession.range(1).select(F.col("id").alias("tree"), F.array().cast(f"array<{_STEP}>").alias("above"))
    tops = _with_proofs(last, upper, nothing, fan)
    root = tops.select("top").first()
    tops = tops.select(F.col("lo").alias("tree"), F.col("proof").alias("above"))
    proved = _with_proofs(leaves, levels, tops, fan, ["held"])
    return proved.select(
        *[F.col("held")[c].alias(c) for c in keep], F.col("digest").alias("leaf"), F.col("top").alias("subroot"), F.lit(root and root.top).alias("root"), "proof"
    )


def proof_text(proof: Column) -> Column:
    """All sibling digests of a proof in a row, level by level, from left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s.before, s.after)), "")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give; another than the manifest's tells that the row was changed."""
    return F.aggregate(proof, leaf, lambda d, s: F.sha2(F.concat(s.before, d, s.after), 256))
