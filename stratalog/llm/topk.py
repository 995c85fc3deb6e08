"""Exact top-k inner products by k-d trees, one a shard.

Nodes split at the median of their widest dimension and keep the tight box of their points. For a query the box
bounds the inner product from above, so nodes are visited best bound first and left as soon as the bound can't beat
the k-th score. Shards are the regions of one k-d tree over all points, whose upper levels come from a sample; queries
are blocked by region too. A block first visits the shard whose root box bounds it highest. Then it goes only to shards
whose root boxes can beat the k-th scores it has by then, best first, and takes its k-th scores along.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import forget, in_small_batches, running, written


@dataclass(frozen=True)
class TopKParams:
    k: int = 20
    scale: float = 64.0  # components become floor(scale * x)
    shard_rows: int = 8192  # mean points of a tree; a region with more than twice as many is dealt over several
    block_rows: int = 8192  # queries that go from tree to tree together, at most
    leaf_rows: int = 256
    cell_trees: int = 8  # mean trees that one task visits with a block; with the block they lie in its memory
    sample_rows: int = 16384  # points that the regions are drawn from, about; they decide on speed alone


@dataclass(frozen=True)
class Tree:
    ids: np.ndarray
    rows: np.ndarray  # numbers of the points' rows
    points: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    spans: np.ndarray  # per node: first point, end, left child, right child (-1: leaf)
    least_id: np.ndarray

    def dump(self) -> bytes:
        out = io.BytesIO()
        for x in (self.ids, self.rows, self.points, self.lo, self.hi, self.spans, self.least_id):
            np.save(out, x, allow_pickle=False)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Tree:
        source = io.BytesIO(data)
        return Tree(*[np.load(source, allow_pickle=False) for _ in range(7)])


def build_tree(ids: np.ndarray, rows: np.ndarray, points: np.ndarray, leaf_rows: int) -> Tree:
    """Median splits down to leaves; equal points may fall on both sides, which boxes and bounds don't mind."""
    order = np.arange(len(ids))
    lo, hi, spans = [], [], []
    todo = [(0, len(ids), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        node, part = len(spans), points[order[a:b]]
        if parent >= 0:
            spans[parent][2 + side] = node
        lo.append(part.min(axis=0))
        hi.append(part.max(axis=0))
        spans.append([a, b, -1, -1])
        if b - a > leaf_rows:
            wide = int(np.argmax(hi[-1] - lo[-1]))
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, wide], middle)]
            todo += [(a, a + middle, node, 0), (a + middle, b, node, 1)]
    ids = ids[order]
    spans = np.array(spans, np.int64)
    least = np.array([ids[a:b].min() for a, b in spans[:, :2]], np.int64)
    return Tree(ids, rows[order], points[order], np.array(lo), np.array(hi), spans, least)


def region_tree(sample: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and value of each split of a complete binary tree with ``levels`` levels, children of i at 2i+1, 2i+2."""
    dims, values = np.zeros((1 << levels) - 1, np.int64), np.zeros((1 << levels) - 1, np.int64)
    parts = {0: sample}
    for i in range(len(dims)):
        part = parts.pop(i)
        if len(part):
            dims[i] = np.argmax(part.max(axis=0) - part.min(axis=0))
            values[i] = np.partition(part[:, dims[i]], (len(part) - 1) // 2)[(len(part) - 1) // 2]
        low = part[:, dims[i]] <= values[i]
        parts |= {2 * i + 1: part[low], 2 * i + 2: part[~low]}
    return dims, values


def regions_of(points: np.ndarray, dims: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Number of the region that each point falls into, from 0."""
    at = np.zeros(len(points), np.int64)
    while len(dims) and at.min(initial=len(dims)) < len(dims):
        at = 2 * at + 1 + (points[np.arange(len(points)), dims[at]] > values[at])
    return at - len(dims)


class Search:
    """The best k candidates of each query of a block, over all trees seen so far.

    ``floors`` are scores that a candidate must reach: k-th scores that the queries have found elsewhere.
    """

    def __init__(self, rows: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None) -> None:
        self.rows, self.queries, self.k = rows, queries, k
        self.floors = np.full(len(rows), np.iinfo(np.int64).min) if floors is None else floors
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in rows]
        self.leaves = self.visited = 0

    def _number(self, tree: Tree) -> type:
        """Products are exact in float64 up to 2**53; beyond that integers are multiplied."""
        largest = float(np.abs(self.queries).max(initial=0)) * float(max(np.abs(tree.lo).max(), np.abs(tree.hi).max()))
        return np.float64 if largest * self.queries.shape[1] < 2**53 else np.int64

    def visit(self, tree: Tree) -> None:
        number = self._number(tree)
        queries, points = self.queries.astype(number), tree.points.astype(number)
        bounds = np.maximum(queries, 0) @ tree.hi.astype(number).T + np.minimum(queries, 0) @ tree.lo.astype(number).T
        spans, least = tree.spans.tolist(), tree.least_id.tolist()
        self.leaves += len(self.rows) * sum(left < 0 for _, _, left, _ in spans)
        for i, (own, floor, q) in enumerate(zip(self.rows.tolist(), self.floors.tolist(), queries, strict=True)):
            bound, (scores, found) = bounds[i].tolist(), self.best[i]
            heap = [(-bound[0], 0)]
            while heap:
                top, node = heapq.heappop(heap)
                full = len(scores) == self.k
                if -top < floor or full and -top < scores[-1]:
                    break
                if full and -top == scores[-1] and least[node] > found[-1]:
                    continue
                a, b, left, right = spans[node]
                if left >= 0:
                    heapq.heappush(heap, (-bound[left], left))
                    heapq.heappush(heap, (-bound[right], right))
                    continue
                self.visited += 1
                s, ids = points[a:b] @ q, tree.ids[a:b]
                good = (tree.rows[a:b] != own) & (s >= (max(floor, scores[-1]) if full else floor))
                if good.any():
                    scores, found = np.concatenate([scores, s[good].astype(np.int64)]), np.concatenate([found, ids[good]])
                    order = np.lexsort((found, -scores))[: self.k]
                    scores, found = scores[order], found[order]
            self.best[i] = (scores, found)

    def results(self, ids: np.ndarray) -> pa.RecordBatch:
        counts = [len(s) for s, _ in self.best]
        columns = [np.repeat(self.rows, counts), np.repeat(ids, counts)]
        columns += [np.concatenate([x[k] for x in self.best] or [[]]).astype(np.int64) for k in (1, 0)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["query", "query_id", "vec_id", "score"])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return rows.flatten().to_numpy().reshape(len(rows), -1)


def _in_regions(rows: DataFrame, n: int, dims: int, p: TopKParams) -> DataFrame:
    """``rows`` with ``shard``, the region of their vector, and ``part``: a region of too many rows has several trees.

    Regions come from about ``sample_rows`` rows, which is what the driver sees. Equal vectors share a region, whatever
    their number, so regions are dealt over parts by row.
    """
    levels = max(0, int(np.ceil(np.log2(max(1, n / p.shard_rows)))))
    every = max(1, n // p.sample_rows)
    sample = rows.where(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).select("v").limit(2 * p.sample_rows).toArrow()
    splits = region_tree(_matrix(sample.column("v")) if sample.num_rows else np.zeros((0, dims), np.int64), levels)

    def region(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(regions_of(_matrix(column), *splits) if len(column) else np.empty(0, np.int64))

    placed = written(rows.withColumn("shard", F.arrow_udf(region, "long")("v")), "regions")
    sizes = placed.groupBy("shard").agg(F.count("*").alias("n"))
    sizes = written(sizes.withColumn("parts", F.when(F.col("n") > 2 * p.shard_rows, F.ceil(F.col("n") / p.shard_rows)).otherwise(1)), "sizes")
    return placed.join(sizes.select("shard", "parts"), "shard").withColumn("part", F.pmod(F.xxhash64("row"), "parts")).drop("parts")


def top_inner_products(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", params: TopKParams | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` (a condition on ``vectors``) its k best others.

    Components become the integers floor(scale * x), x as double; the score is their inner product, ties go to the
    smaller id. Candidates of a query are all rows but its own; it lists all of them if they are fewer than k. Rows
    with a null id, a null vector, or a null or non-finite component take no part; shorter vectors count as filled up
    with zeros. A query row that is repeated is answered as often, and repeated candidates are listed so. Other columns
    are ignored, whatever their names. An empty table gives an empty table.

    In memory are a block and some trees, ``cell_trees`` on average. Blocks are as large as memory allows, so that points are
    copied to few of them: once each up to ``block_rows`` queries. A block's trees are dealt over cells, whose best lists are
    merged; a block is sent to a cell once, so what is shuffled are the trees and a ``cell_trees``-th of as many blocks. Where boxes bound nothing, as with vectors that lie evenly in many dimensions, the work is queries times rows.
    """
    p, spark = params or TopKParams(), vectors.sparkSession
    in_small_batches(spark)
    whole = F.transform(vector_col, lambda x: F.floor(F.lit(p.scale) * x.cast("double")))
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), is_query.alias("q"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "vectors")
    n, asked, dims = rows.agg(F.count("*"), F.count_if("q"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dims, blocks = max(dims, 1), max(1, -(-asked // p.block_rows))
    filled = F.slice(F.concat("v", F.array_repeat(F.lit(0).cast("long"), dims)), 1, dims)
    spread = written(_in_regions(rows.withColumn("v", filled), n, dims, p), "spread")

    box = lambda x: pa.array([x.tolist()], pa.list_(pa.int64()))

    def plant(table: pa.Table) -> pa.Table:
        tree = build_tree(table.column("id").to_numpy(), table.column("row").to_numpy(), _matrix(table.column("v")), p.leaf_rows)
        return pa.table({"lo": box(tree.lo[0]), "hi": box(tree.hi[0]), "tree": pa.array([tree.dump()], pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        v = _matrix(table.column("v"))
        data = {k: pa.array([x.tobytes()], pa.binary()) for k, x in (("rows", table.column("row").to_numpy()), ("ids", table.column("id").to_numpy()), ("v", v))}
        return pa.table({"block": table.column("block").slice(0, 1), **data, "q_lo": box(v.min(axis=0)), "q_hi": box(v.max(axis=0))})

    forest = spread.groupBy("shard", "part").applyInArrow(plant, "lo array<long>, hi array<long>, tree binary")
    forest = written(forest.withColumn("tree_id", F.monotonically_increasing_id()), "trees")
    ranked = running(spread.where("q").select("shard", "row", "id", "v"), ["shard", "row"])
    ranked = ranked.withColumn("block", F.expr(f"rank div {p.block_rows}"))
    asking = written(ranked.groupBy("block").applyInArrow(gather, "block long, rows binary, ids binary, v binary, q_lo array<long>, q_hi array<long>"), "blocks")

    # Root boxes meet the boxes of the blocks; no vectors are needed for that. What doubles may lose is added.
    at = lambda a, i: F.get(a, i).cast("double")
    corner = lambda i: F.greatest(*[at(a, i) * at(b, i) for a in ("lo", "hi") for b in ("q_lo", "q_hi")])
    bound = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), corner), F.lit(1.0), lambda x, y: x + y + F.abs(y) * 1e-9)
    boxes = forest.select("tree_id", "lo", "hi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    near = boxes.join(asking.select("block", "q_lo", "q_hi"), "block").select("block", "tree_id", bound.alias("bound"))
    near = written(near, "near")
    first = near.groupBy("block").agg(F.max_by("tree_id", F.struct("bound", "tree_id")).alias("tree_id"))
    queries = asking.select("block", "rows", "ids", "v")

    def numbers(x: pa.Scalar) -> np.ndarray:
        return np.frombuffer(x.as_py(), np.int64)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, own, ids, v in zip(*batch.columns, strict=True):
                search = Search(numbers(own), numbers(v).reshape(len(numbers(own)), -1), p.k)
                search.visit(Tree.load(tree.as_py()))
                yield search.results(numbers(ids))

    found = "query long, query_id long, vec_id long, score long"
    home = queries.join(first, "block").join(forest.select("tree_id", "tree"), "tree_id").select("tree", "rows", "ids", "v")
    home = written(home.mapInArrow(begin, found), "home")
    floors = home.groupBy("query").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") == p.k)

    # What each block still needs: its k-th scores as a map from query to floor, and the trees that can beat the lowest.
    floors = ranked.select(F.col("row").alias("query"), "block").join(floors, "query", "left").groupBy("block").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("floor").isNotNull(), F.struct("query", "floor")))).alias("floors"),
        F.min(F.coalesce("floor", F.lit(-(1 << 63)))).alias("lowest"),
    )
    floors = written(floors, "floors")
    groups = max(1, -(-forest.count() // p.cell_trees))
    left = near.join(first, ["block", "tree_id"], "left_anti").join(floors.select("block", "lowest"), "block").where("bound >= lowest")
    left = written(left.select("block", "tree_id", "bound", F.pmod(F.xxhash64("tree_id"), F.lit(groups)).alias("of")), "left")
    # A cell is some trees and a block, each sent to it once: trees on one side, the block on the other.
    trees = left.join(forest.select("tree_id", "tree"), "tree_id").select("block", "of", "bound", "tree")
    asks = left.select("block", "of").distinct().join(queries.join(floors.select("block", "floors"), "block"), "block")
    asks = asks.select(F.col("block").alias("for block"), F.col("of").alias("for of"), "rows", "ids", "v", "floors")

    def run(trees: pa.Table, asks: pa.Table) -> pa.Table:
        own, ids, v = (numbers(asks.column(c)[0]) for c in ("rows", "ids", "v"))
        known = dict(asks.column("floors")[0].as_py())
        least = np.array([known.get(r, -(1 << 63)) for r in own.tolist()], np.int64)
        search = Search(own, v.reshape(len(own), -1), p.k, least)
        trees = trees.sort_by([("bound", "descending")])  # the best first; results don't depend on it
        for tree in trees.column("tree"):
            search.visit(Tree.load(tree.as_py()))
        return pa.Table.from_batches([search.results(ids)])

    rest = trees.groupBy("block", "of").cogroup(asks.groupBy("for block", "for of")).applyInArrow(run, found)
    best = F.struct((-F.col("score")).alias("score"), F.col("vec_id"))
    merged = home.unionByName(rest).groupBy("query", "query_id").agg(F.slice(F.sort_array(F.collect_list(best)), 1, p.k).alias("best"))
    forget(rows)
    out = merged.select("query_id", F.posexplode("best").alias("rank", "b"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.score")).alias("score"))
