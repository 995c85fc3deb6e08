"""Near-duplicate documents: MinHash with tensored banding, every link confirmed on the full shingle sets.

Two collections of ``halves`` half-keys are made, each half-key from ``rows`` minhashes. A table of the banding is
a pair (i, j), and its key joins half-key i of the first collection with half-key j of the second. So
``halves**2`` tables of ``2 * rows`` minhashes each cost only ``2 * halves * rows`` minhashes, about the square root
of what independent tables cost. Two sets collide in some table exactly if they share a half-key in both
collections. For sets of Jaccard similarity s that happens with probability (1 - (1 - s**rows)**halves)**2, which is
0.9996 at s = 0.8 with the defaults and nearer to 1 above. Pairs whose sketches agree in too few minhashes are left
out before the full sets are compared; a pair at the limit is lost by that with a probability below 1e-9.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import forget, in_small_batches, packed, small_batches, written
from stratalog.llm.components import connected_components
from stratalog.llm.shingles import MinHash, WordHashes, odd_numbers, shingle_set


#: Pairs that share a shingle and are made in one task, at most.
PAIRS_A_TASK = 1_000_000
#: Large buckets in which a member meets others, and the members of a cell of such a bucket on average.
PICKS, CELL = 12, 5


@dataclass(frozen=True)
class NearDupParams:
    words: int = 5  # words of a shingle
    percent: int = 80  # smallest Jaccard similarity of a link
    halves: int = 12  # half-keys in each of the two collections
    rows: int = 3  # minhashes of a half-key
    seed: int = 42

    @property
    def minhashes(self) -> int:
        return 2 * self.halves * self.rows

    @property
    def least_agreeing(self) -> int:
        """The largest k such that two sets at the limit agree in fewer than k minhashes with a probability below 1e-9."""
        n, s, tail = self.minhashes, self.percent / 100, 0.0
        for k in range(n + 1):
            tail += math.comb(n, k) * s**k * (1 - s) ** (n - k)
            if tail >= 1e-9:
                return k
        return n


def _sketches(docs: DataFrame, id_col: str, text_col: str, p: NearDupParams) -> DataFrame:
    """Per row: id, two hashes, digest of the shingle set (null for an empty set), its size and its minhashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, factors, minhash = WordHashes(), odd_numbers(p.seed, p.words), MinHash(p.minhashes, p.seed + 7)
        for batch in small_batches(batches, 3):
            digests, sizes, sketches = [], [], []
            for text in batch.column(3).to_pylist():
                s = shingle_set(text, p.words, factors, hashes)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sketches.append(minhash(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.list_(pa.int32()))],
                names=["doc", "text_hash", "at", "digest", "n_shingles", "sketch"],
            )

    rows = docs.select(F.col(id_col).alias("doc"), *_place(id_col, text_col), F.encode(text_col, "UTF-8").alias("text"))
    return rows.mapInArrow(run, f"doc {rows.schema[0].dataType.simpleString()}, text_hash long, at long, digest binary, n_shingles long, sketch array<int>")


def _place(id_col: str, text_col: str) -> list[Column]:
    """Two hashes that rows share only if they have the same id and text."""
    return [F.xxhash64(text_col).alias("text_hash"), F.xxhash64(F.lit(1), id_col, text_col).alias("at")]


def _full_sets(texts: DataFrame, p: NearDupParams) -> DataFrame:
    """(node, text) -> node and the shingles of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, factors = WordHashes(), odd_numbers(p.seed, p.words)
        for batch in small_batches(batches, 1):
            sets = [shingle_set(text, p.words, factors, hashes) for text in batch.column(1).to_pylist()]
            lengths = np.cumsum([0] + [len(s) for s in sets])
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat))], names=["node", "shingles"]
            )

    return texts.mapInArrow(run, "node long, shingles array<long>")


def _buckets(nodes: DataFrame, p: NearDupParams) -> DataFrame:
    """(bucket, node, n, lo, hi): members of table keys that n sets share, two at least, with two of these.

    The two are the first and the last in an order by hash. They are aggregates, so no task sees a whole bucket.

    A half-key that only one set has can't be part of a shared table key, so it is dropped before the two
    collections are multiplied: only sets that share half-keys on both sides get table keys at all.
    """
    first = F.col("sketch")
    half = F.transform(
        F.sequence(F.lit(0), F.lit(2 * p.halves - 1)),
        lambda i: F.struct((i < p.halves).alias("left"), F.xxhash64(i, *[F.get(first, i * p.rows + r) for r in range(p.rows)]).alias("key")),
    )
    halves = nodes.select("node", F.explode(half).alias("h")).select("node", "h.left", "h.key")
    often = written(halves.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "halves")
    sides = halves.join(often, "key", "left_semi").groupBy("node").agg(
        F.collect_list(F.when(F.col("left"), F.col("key"))).alias("a"), F.collect_list(F.when(~F.col("left"), F.col("key"))).alias("b")
    )
    keys = sides.select(
        "node", F.explode(F.flatten(F.transform("a", lambda a: F.transform("b", lambda b: F.xxhash64(a, b))))).alias("bucket")
    )
    keys = written(keys, "keys")
    own = F.struct(F.xxhash64("node"), "node")
    shared = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.min(own).alias("lo"), F.max(own).alias("hi")).where("n > 1")
    shared = written(shared.select("bucket", "n", F.col("lo.node").alias("lo"), F.col("hi.node").alias("hi")), "shared")
    live = written(keys.join(shared, "bucket"), "buckets")
    forget(often, keys, shared)
    return live


def _meetings(members: DataFrame) -> DataFrame:
    """Pairs (a, b): members of a bucket that meet before the exact comparison.

    In buckets of up to three members these are all pairs. Of its larger buckets a member takes PICKS, the smallest, the
    largest and some by hash, and meets those that a hash deals into the same cell of one of them. A cell has CELL
    members on average, however large the bucket, so pairs grow with the members alone; and as the company is a random
    one each time, a group of many links falls into one component but for a few members.
    """
    small = members.where("n <= 3").select("node", F.explode(F.array("lo", "hi")).alias("m")).where("m <> node")
    small = small.select(F.least("node", "m").alias("a"), F.greatest("node", "m").alias("b"))
    by_hash = lambda t: F.min(F.struct(F.xxhash64(F.lit(t), "bucket").alias("h"), "n", "bucket"))
    size = F.struct(F.lit(0).cast("long").alias("h"), "n", "bucket")
    picks = [F.min(size), F.max(size), *[by_hash(t) for t in range(PICKS - 2)]]
    taken = members.where("n > 3").groupBy("node").agg(F.array(*picks).alias("picks")).select("node", F.posexplode("picks").alias("pick", "p"))
    cell = F.pmod(F.xxhash64("pick", "node"), F.ceil(F.col("p.n") / CELL))
    company = taken.groupBy("pick", "p.bucket", cell.alias("cell")).agg(F.sort_array(F.collect_list("node")).alias("ns")).where("size(ns) > 1")
    every = F.flatten(F.transform("ns", lambda a: F.transform(F.filter("ns", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return small.unionByName(company.select(F.explode(every).alias("pair")).select("pair.a", "pair.b")).distinct()


def _by_rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share one of their rarest shingles; sets are (node, component, shingles).

    Two sets of Jaccard similarity t or more share a shingle among the rarest n - ceil(t * n) + 1 of each, in any common
    order of shingles; and from the first one they share, enough of both must follow for the overlap that t asks for. So
    no link is lost, and what large groups have in common is not looked at. The members of a shingle's largest component
    aren't compared with each other at all. The pairs of a shingle that many sets have are dealt over several tasks.
    """
    tokens = sets.select("node", F.explode("shingles").alias("shingle"))
    order = written(tokens.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "order")
    # A shingle that only one set has is rarest of all, and no other set can share it: it only takes up a place.
    ranked = tokens.join(order, "shingle").select("node", F.struct("n", "shingle").alias("t"))
    shared = ranked.groupBy("node").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    n, alone = F.size("shingles"), F.size("shingles") - F.size("ts")
    places = n - F.expr(f"(size(shingles) * {percent} + 99) div 100") + 1 - alone
    some = sets.join(shared, "node").where(places > 0)
    prefix = some.select("node", "component", n.alias("n"), alone.alias("alone"), F.posexplode(F.slice("ts", 1, places.cast("int"))).alias("i", "t"))
    # rest: shingles from this one on
    prefix = written(prefix.select("node", "component", F.col("n").alias("of"), (F.col("n") - F.col("alone") - F.col("i")).alias("rest"), "t.shingle"), "rare")
    counts = prefix.groupBy("shingle", "component").agg(F.count("*").alias("m"))
    major = counts.groupBy("shingle").agg(
        F.max_by("component", F.struct("m", "component")).alias("major"), F.count("*").alias("parts"), F.sum("m").alias("n"), F.max("m").alias("m")
    )
    tasks = F.ceil(F.col("n") * (F.col("n") - F.col("m")) / PAIRS_A_TASK).cast("int").alias("tasks")
    major = written(major.where("parts > 1").select("shingle", "major", tasks), "major")
    rows = written(prefix.join(major, "shingle"), "rows")
    x = rows.where("component <> major").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).alias("x")
    y = rows.withColumn("task", F.pmod(F.xxhash64("node"), F.col("tasks")).cast("int")).alias("y")
    # A pair of which neither is in the largest component comes twice; one of the two is enough.
    once = F.expr("x.component <> y.component AND (y.component = y.major OR x.node < y.node)")
    enough = F.expr(f"{100 + percent} * least(x.rest, y.rest) >= {percent} * (x.of + y.of)")
    both = x.join(y, F.expr("x.shingle = y.shingle AND x.task = y.task") & once & enough)
    return both.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _agreeing(a: Column, b: Column) -> Column:
    """Number of minhashes in which two sketches agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def _attached(pairs: DataFrame, nodes: DataFrame, how: str = "inner") -> DataFrame:
    """Pairs (a, b) with the columns of ``nodes`` for both, named a_column and b_column."""
    for end in ("a", "b"):
        side = nodes.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in nodes.columns if c != "node"])
        pairs = pairs.join(side, end, how)
    return pairs


def _likely(pairs: DataFrame, nodes: DataFrame, p: NearDupParams) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    sized = _attached(pairs, nodes)
    possible = 100 * F.least("a_n_shingles", "b_n_shingles") >= p.percent * F.greatest("a_n_shingles", "b_n_shingles")
    return sized.where(possible).where(_agreeing(F.col("a_sketch"), F.col("b_sketch")) >= p.least_agreeing).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, p: NearDupParams) -> DataFrame:
    """The distinct pairs (a, b) that are links: their full sets are similar enough.

    Nothing above these joins asks for their partitioning, so that Spark may split the pairs of a hub.
    """
    pairs = written(pairs, "pairs")
    common = F.size(F.array_intersect("a_shingles", "b_shingles"))
    union = F.size("a_shingles") + F.size("b_shingles") - F.col("common")
    both = _attached(pairs, sets).withColumn("common", common)
    links = written(both.where(100 * F.col("common") >= p.percent * union).select("a", "b"), "links")
    forget(pairs)
    return links


def _merged(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after links between components; only nodes that have a link are listed."""
    if parts is None:
        return written(connected_components(links), "parts")
    edges = _attached(links, parts, "left")
    edges = edges.select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b"))
    joined = connected_components(edges)
    renamed = joined.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    moved = parts.join(renamed, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    return written(moved.unionByName(joined.join(parts.select("node"), "node", "left_anti")), "parts")


def _linked(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, p: NearDupParams) -> DataFrame:
    """(node, component) of the nodes that have a link."""
    spark = docs.sparkSession
    live = _buckets(nodes, p)
    # The full sets of all nodes in a bucket, once, each from one of its texts; the join deals texts out by their place.
    needed = nodes.join(live.select("node").distinct(), "node", "left_semi").select("node", "text_hash", "at")
    texts = docs.select(*_place(id_col, text_col), F.encode(text_col, "UTF-8").alias("text")).join(needed, ["at", "text_hash"])
    texts = texts.groupBy("at", "text_hash").agg(F.first("node").alias("node"), F.first("text").alias("text"))  # rows can be repeated
    sets = written(_full_sets(texts.select("node", "text"), p), "sets")
    slim = nodes.select("node", "n_shingles", "sketch")

    parts = None
    met = written(_meetings(live), "met")
    links = _confirmed(_likely(met, slim, p), sets, p)
    members = live.select("bucket", "node", F.col("node").alias("component"))
    if not links.isEmpty():
        parts = _merged(parts, links)
        members = live.join(parts, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    # Buckets of three or fewer members have been compared in full; those in one component need no comparison.
    mixed = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = written(mixed.where("n > 3 AND lo <> hi").select("bucket"), "mixed")
    left = written(members.join(mixed, "bucket", "left_semi").select("node", "component").distinct(), "open")
    links = _confirmed(_by_rare_shingles(sets.join(left, "node"), p.percent), sets, p)  # of these pairs sketches tell nothing new
    if not links.isEmpty():
        parts = _merged(parts, links)
    forget(sets, live, met, mixed, left)
    return spark.createDataFrame([], "node long, component long") if parts is None else parts


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: NearDupParams | None = None) -> DataFrame:
    """Per row of ``docs``: its id, n_shingles, component_id (smallest id reachable over links), kept, class, text_hash.

    Texts are lower-cased in A-Z and split at ASCII white space; the set of a text holds its distinct shingles of
    ``words`` words, or its whole sequence where it has fewer. A text that is null or has no words has an empty
    set, is linked with nothing, and is its own component. Rows with equal sets are always linked. A component
    whose ids are all null has a null component_id. ``kept`` says that the id is the component's (nulls are equal
    here); ``class`` is one number per component, null for empty sets; ``text_hash`` is xxhash64 of the text. Repeated
    rows get equal results. Texts of any length are taken whole. Other columns are ignored, whatever their names. An
    empty table gives an empty table.

    Equal sets are collapsed first (with map-side combining), so a group of exact copies is one node. Buckets are
    never expanded into all pairs: each member meets a few others that a hash deals it, which makes large groups fall
    into one component. What is then still apart within a bucket is compared where sets of different components share one of their rarest shingles, which loses no link. Where many
    rows may share a key, the other side of the join is an aggregated table that is written first, and nothing above
    the join depends on its partitioning: adaptive execution then splits the rows of such a key over several tasks.
    """
    p, spark = params or NearDupParams(), docs.sparkSession
    in_small_batches(spark)
    rows = written(_sketches(docs, id_col, text_col, p), "sketches")
    distinct = rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc").alias("first_doc"),
        F.min(F.struct("at", "text_hash")).alias("place"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("sketch").alias("sketch"),
    )
    distinct = distinct.select("digest", "first_doc", "place.at", "place.text_hash", "n_shingles", "sketch")
    nodes = written(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    parts = _linked(nodes, docs, id_col, text_col, p)

    placed = nodes.join(parts, "node", "left").select("digest", "first_doc", F.coalesce("component", "node").alias("class"))
    heads = written(placed.groupBy("class").agg(F.min("first_doc").alias("component_id")), "heads")
    classes = placed.join(heads, "class").select("digest", "class", "component_id")
    slim = rows.select("doc", "text_hash", "n_shingles", "digest")
    full = slim.where("digest IS NOT NULL").join(classes, "digest")
    empty = slim.where("digest IS NULL").withColumns({"class": F.lit(None).cast("long"), "component_id": F.col("doc")})
    return full.unionByName(empty).select(
        F.col("doc").alias(id_col),
        "n_shingles",
        "component_id",
        F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"),
        "class",
        "text_hash",
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: NearDupParams | None = None) -> DataFrame:
    """The rows of ``docs`` with one document of each near-duplicate group: the one with the smallest id.

    Documents without words are groups of their own. Rows of one group with equal ids are one document, and so are
    the rows of a group whose ids are all null: one of them stays. All columns are kept, whatever their names. An
    empty table gives an empty table.

    Which rows stay is decided on ids and hashes; then texts are joined once. Only rows that are repeated as a whole
    are looked at again.
    """
    classes = near_duplicate_classes(docs, id_col, text_col, params).where("kept").select(F.col(id_col).alias("id"), "class", "text_hash")
    # Of the texts of one id in one class the one with the smallest hash stays; without words, each text stays.
    own = F.coalesce("class", "text_hash")
    kept = classes.groupBy("id", F.col("class").isNull().alias("empty"), own.alias("own")).agg(
        F.min("text_hash").alias("text_hash"), F.count("*").alias("n")
    )
    kept = written(kept.select("id", "text_hash", "n").groupBy("id", "text_hash").agg(F.max("n").alias("n")), "kept")
    rows = docs.select(packed(docs).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash")).alias("d")
    same = F.expr("d.id <=> k.id AND d.text_hash = k.text_hash")
    out = rows.join(kept.where("n = 1").alias("k"), same, "left_semi").select("row")
    often = kept.where("n > 1")
    if not often.isEmpty():
        again = rows.join(often.alias("k"), same, "left_semi").dropDuplicates(["id", "text_hash"])
        out = out.unionByName(again.select("row"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])
