"""Mixing sources to target weights by weighted fair queueing.

Every source sends its documents in a shuffled order, again and again. A document's virtual finish time is the
words its source has sent up to its end, divided by the source's target; the mix takes documents in the order of
these times until the budget is spent, so that all sources reach their targets together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import forget, running, word_count, written


def targets_by_weight(sources: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """(source, source_size, start, target) from (source, source_size): shares of ``share`` times the total size.

    Sources in the order of their code points, null last, get ``weights`` in turn. No target exceeds ``most`` times
    its source's size; what is cut off is shared again by weight among the rest. With sources in the order of
    size per weight, exactly a first part of them is capped: source k is capped if its cap per weight is at most
    what the rest would get per weight after all caps before it. That is two running sums over the sources, of
    which there is a row each; they are range-sorted, so there may be many. ``start`` is the size of all sources before.
    """
    name = [F.col("source").isNull(), F.col("source")]
    named = running(sources, name, ["source_size"])
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights)).cast("int")).cast("long")
    named = named.select("source", "source_size", F.col("source_size_before").alias("start"), weight.alias("weight"))
    named = named.withColumn("cap", F.col("source_size") * F.lit(most))
    total, heavy = named.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    sums = running(named, [F.col("cap") / F.col("weight"), *name], ["cap", "weight"])
    level = (F.lit(total * share) - F.col("cap_before")) / (F.lit(heavy) - F.col("weight_before"))
    rest = sums.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    level = rest.agg(F.max(F.when(~F.col("capped"), F.col("level")))).first()[0]
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.lit(level).cast("double") * F.col("weight"))
    return rest.select("source", "source_size", "start", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    rounds: int = 2,
    seed: int = 42,
) -> DataFrame:
    """Per row of ``docs``: id, source, size, source_size, target, ``taken`` words and ``copies`` in the mix.

    The size of a row is its number of words unless ``size`` says otherwise; texts of any length count in full. The
    budget is ``share`` times all sizes, and no row is taken more than ``rounds`` times. The row in which the budget
    ends is taken in part (it counts as a copy); no row after it is taken. Rows of size 0 have ``copies`` 1 if their
    first finish time lies within the budget. Null sources are one source, the last. Order and ties are fixed by hashes
    of the id, then the id, then the size, so reruns agree; rows equal in all of these are interchangeable. A source's
    words in the mix are within one document of it from its target, the largest one at most, as its finish times grow by a
    document's share at a time; the source in which the budget ends is within two. Other columns
    are ignored, whatever their names. An empty table gives an empty table.

    A source may hold most rows: the documents of all sources are range-sorted by source and shuffled place, all
    finish times are range-sorted, and running sums add up those of partitions. A source's numbers reach its rows by a
    join that adaptive execution can split.
    """
    rows = docs.select(
        F.col(id_col).alias("doc"),
        F.col(source_col).alias("source"),
        (word_count(F.col("text")) if size is None else size).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("order"),
    )
    rows = written(rows, "sizes")
    per_source = written(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    key = F.struct("source").alias("key")  # null is a source like any other
    targets = written(targets_by_weight(per_source, weights, share, rounds).withColumn("key", key), "targets")
    budget = int((per_source.agg(F.sum("source_size")).first()[0] or 0) * share)
    sent = running(rows, [F.col("source").isNull(), "source", "order", "doc", "size"], ["size"]).withColumn("key", key)
    sent = sent.join(targets.drop("source"), "key")
    upto = F.col("size_before") - F.col("start") + F.col("size")
    sent = written(sent.select("rank", "doc", "source", "size", "order", "source_size", "target", upto.alias("sent")), "sent")

    # One row for every time that a document can be sent.
    times = sent.select("rank", "size", "order", "source_size", "target", "sent", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    finish = F.coalesce(F.try_divide(F.col("round") * F.col("source_size") + F.col("sent"), F.col("target")), F.lit(0.0))
    times = times.select(F.col("rank").alias("row"), "size", finish.alias("finish"), "round")
    queue = running(times, ["finish", "row", "round"], ["size"])
    got = F.greatest(F.lit(0), F.least(F.col("size"), F.lit(budget) - F.col("size_before")))
    copy = (F.col("got") > 0) | ((F.col("size") == 0) & (F.col("size_before") <= budget))
    queue = queue.withColumn("got", got).withColumn("copy", copy.cast("int"))
    copies = F.when(F.max("size") == 0, F.max("copy")).otherwise(F.sum("copy"))
    taken = queue.groupBy(F.col("row").alias("rank")).agg(F.sum("got").cast("long").alias("taken"), copies.cast("int").alias("copies"))
    forget(rows, per_source)
    return sent.join(taken, "rank").select(F.col("doc").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken", "copies")
