"""Exact top-k inner-product search over KD-trees, one per shard of the candidates.

Method: candidates are dealt to shards of bounded size by their id; a task
builds the KD-tree of its shard (median splits of the widest dimension, each
node with its tight bounding box) and answers a block of queries by best-first
traversal, leaving out nodes whose box bound is below the query's kth score.
Each query first searches one shard; the kth score found there goes with it to
all other shards, so most of their boxes are pruned where the data allow it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgauge.llm.minhash import by_group
from landgauge.llm.scratch import cut, width

SHARD_ROWS, QUERY_ROWS, LEAF_ROWS = 4096, 8192, 64
LOWEST = -(1 << 63)
EXACT = float(1 << 53)


class KDTree:
    """Median-split tree over the rows of a matrix; node i has children left[i], right[i] (-1: a leaf)."""

    def __init__(self, rows: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        self.order = np.arange(len(rows))
        self.begin, self.end, self.left, self.right = [], [], [], []
        low, high = [], []
        todo = [(0, len(rows), -1, False)]
        while todo:
            a, b, parent, is_right = todo.pop()
            node = len(self.begin)
            part = rows[self.order[a:b]]
            lo, hi = part.min(axis=0), part.max(axis=0)
            self.begin.append(a), self.end.append(b), self.left.append(-1), self.right.append(-1)
            low.append(lo), high.append(hi)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            if b - a > leaf_rows and len(lo) and (hi > lo).any():
                middle = (a + b) // 2
                split = np.argpartition(part[:, int(np.argmax(hi - lo))], middle - a)
                self.order[a:b] = self.order[a:b][split]
                todo += [(middle, b, node, True), (a, middle, node, False)]
        self.low, self.high = np.array(low), np.array(high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """[queries, nodes]: the largest inner product that a point of the node's box can have."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def search(tree: KDTree, rows: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int, kth: int, bounds: np.ndarray) -> list[tuple[int, int]]:
    """(score, -id) of the best k rows that reach `kth`, in no order. `rows`, `ids` in tree order."""
    best: list[tuple[int, int]] = []
    open_nodes = [(-bounds[0], 0)]
    while open_nodes:
        bound, node = heapq.heappop(open_nodes)
        if -bound < kth:
            break
        if tree.left[node] >= 0:
            for child in (tree.left[node], tree.right[node]):
                if bounds[child] >= kth:
                    heapq.heappush(open_nodes, (-bounds[child], child))
            continue
        a, b = tree.begin[node], tree.end[node]
        scores = rows[a:b] @ query
        for i in np.flatnonzero(scores >= kth):
            if ids[a + i] == own:
                continue
            found = (int(scores[i]), -int(ids[a + i]))
            if len(best) < k:
                heapq.heappush(best, found)
            elif found > best[0]:
                heapq.heapreplace(best, found)
        if len(best) == k:
            kth = max(kth, best[0][0])
    return best


def _search_grid(placed: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score per cell of shards x query blocks.

    `placed` dim, shard, block, is_query, id, kth, vec (array<long>).
    """
    keys = ["dim", "shard", "block"]
    dealt = placed.select(*keys, "is_query", "id", "kth", "vec").repartition(width(placed.sparkSession), *keys).sortWithinPartitions(*keys)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, keys):
            asks = group.column(3).to_numpy(zero_copy_only=False)
            ids, kth = group.column(4).to_numpy(), group.column(5).to_numpy()
            vectors = group.column(6).flatten().to_numpy().reshape(group.num_rows, group.column(0)[0].as_py())
            if asks.all() or not asks.any():
                continue
            top = float(np.abs(vectors[asks]).max(initial=0)) * float(np.abs(vectors[~asks]).max(initial=0)) * max(1, vectors.shape[1])
            vectors = vectors.astype(np.float64) if top < EXACT else vectors  # whole numbers below 2**53 are exact as doubles
            rows, row_ids = vectors[~asks], ids[~asks]
            tree = KDTree(rows)
            rows, row_ids = rows[tree.order], row_ids[tree.order]
            out: list[tuple[int, int, int]] = []
            queries, query_ids, bars = vectors[asks], ids[asks], kth[asks]
            for a in range(0, len(queries), 512):
                bounds = tree.bounds(queries[a : a + 512])
                for i, b in enumerate(bounds, a):
                    out += [(int(query_ids[i]), -v, s) for s, v in search(tree, rows, row_ids, queries[i], query_ids[i], k, int(bars[i]), b)]
            if out:
                q, v, s = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])

    return dealt.mapInArrow(answer, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query by whole-number inner product.

    Each component x becomes floor(scale * x). Queries are the rows where
    `is_query` holds; candidates are all rows but those of the query's own id.
    Ties go to the smaller id. Vectors that are null or hold a null or
    non-finite component, and rows with a null id, take no part; only vectors
    of equal length are compared; of repeated rows of one id the largest vector
    counts. A query with fewer than k candidates gets all of them.
    """
    x = F.col(vector_col)
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    ready = cut(
        vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & ~bad)
        .select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), whole.alias("vec"))
        .groupBy("id").agg(F.max(F.struct("vec", "q")).alias("_v"))
        .select("id", "_v.vec", "_v.q", F.size("_v.vec").alias("dim"))
    )
    counts = ready.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q"), 1)).alias("q")).first()
    shards, blocks = max(1, -(-counts.n // SHARD_ROWS)), max(1, -(-counts.q // QUERY_ROWS))
    dealt = ready.select(
        "dim", "id", "vec", "q", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"),
    )
    grid = ["dim", "shard", "block", "is_query", "id", "kth", "vec"]
    all_blocks, all_shards = F.sequence(F.lit(0), F.lit(blocks - 1)), F.sequence(F.lit(0), F.lit(shards - 1))
    rows = dealt.withColumn("block", F.explode(all_blocks)).select(
        "dim", "shard", "block", F.lit(False).alias("is_query"), "id", F.lit(LOWEST).alias("kth"), "vec"
    )
    asking = dealt.filter("q")
    own = asking.select("dim", "shard", "block", F.lit(True).alias("is_query"), "id", F.lit(LOWEST).alias("kth"), "vec")
    first = cut(_search_grid(rows.unionByName(own).select(*grid), k))
    bars = first.groupBy(F.col("query_id").alias("id")).agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(LOWEST)).alias("kth")
    )
    others = (
        asking.join(bars, "id", "left")
        .withColumn("_to", F.explode(all_shards))
        .filter("_to <> shard")
        .select("dim", F.col("_to").alias("shard"), "block", F.lit(True).alias("is_query"), "id", F.coalesce("kth", F.lit(LOWEST)).alias("kth"), "vec")
    )
    found = first.unionByName(_search_grid(rows.unionByName(others).select(*grid), k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
