import numpy as np
from pyspark.sql import functions as F

from landgauge.llm import topk


def brute(rows, k=5):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good[i] = np.floor(256 * np.array(v, np.float64)).astype(np.int64)
    out = []
    for q, v in good.items():
        if q % 50 == 0:
            best = sorted((-int(v @ w), c) for c, w in good.items() if c != q and len(w) == len(v))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


def result(rows, spark, **kw):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = topk.top_k(vectors, F.col("vec_id") % 50 == 0, **kw)
    return sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect())


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    return [(i, [float(np.float32(x)) for x in centres[i % 20] * (1 + i % 3) + 0.05 * rng.normal(size=dim)]) for i in range(n)]


def test_shards_and_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 200)
    monkeypatch.setattr(topk, "QUERY_ROWS", 5)
    rows = clustered(900, 6, 1)
    assert result(rows, spark) == brute(rows)


def test_ties_copies_and_odd_vectors(spark):
    rows = [(i, [0.5, 0.25]) for i in range(120)]  # all alike: ties go to the smaller id
    rows += [(150, None), (200, [float("nan"), 1.0]), (201, [float("inf"), 1.0]), (202, [None, 1.0]), (None, [9.0, 9.0]), (250, []), (300, [1.0, 2.0, 3.0]), (301, [1.0, 0.0, -1.0])]
    assert result(rows, spark) == brute(rows)
    assert result([], spark) == []
    assert result(rows + rows[:7], spark) == brute(rows)  # repeated rows of an id count once
    assert len(result([(0, [1.0]), (1, [2.0]), (2, [-1.0])], spark)) == 2  # fewer than k candidates
    huge = [(0, [2.0**40, 1.0]), (1, [-2.0, 5.0]), (2, [2.0, 7.0])]
    assert result(huge, spark) == brute(huge)


def test_columns_that_clash(spark):
    rows = clustered(120, 3, 2)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("shard", F.lit(2)).withColumn("vec", F.lit("x")).withColumn("q", F.lit(3))
    got = topk.top_k(vectors, F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute(rows)


def test_tree_boxes_are_tight_and_searched_best_first():
    rng = np.random.default_rng(4)
    rows = rng.integers(-50, 50, (1000, 3)).astype(np.float64)
    tree = topk.KDTree(rows, leaf_rows=16)
    ordered = rows[tree.order]
    leaves = [i for i, c in enumerate(tree.left) if c < 0]
    assert sorted(sum(([*range(tree.begin[i], tree.end[i])] for i in leaves), [])) == list(range(1000))
    for i in range(len(tree.begin)):
        part = ordered[tree.begin[i] : tree.end[i]]
        assert (part.min(axis=0) == tree.low[i]).all() and (part.max(axis=0) == tree.high[i]).all()
    query = np.array([3.0, -7.0, 11.0])
    bounds = tree.bounds(query[None, :])[0]
    for i in range(len(tree.begin)):
        assert (ordered[tree.begin[i] : tree.end[i]] @ query).max() <= bounds[i]
    got = sorted(topk.search(tree, ordered, tree.order, query, -1, 5, topk.LOWEST, bounds), reverse=True)
    assert got == sorted(((int(s), -int(i)) for i, s in enumerate(rows @ query)), reverse=True)[:5]
