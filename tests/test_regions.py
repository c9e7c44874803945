"""Runs of cells against masks worked out cell by cell."""

import numpy as np
import pytest

from landgauge.operators import regions as R


def mask_of(seed, n=26, p=0.75):
    return np.random.default_rng(seed).random((n, n)) < p


def frame(spark, masks):
    rows = [(k, int(i), int(j)) for k, m in masks.items() for i, j in zip(*np.nonzero(m))]
    return R.runs_of(spark.createDataFrame([*rows, *rows[:50]], "k int, cx int, cy int"), ["k"])


def back(runs, key, n):
    out = np.zeros((n, n), bool)
    for r in R.cells_of(runs, ["k"]).filter(f"k = {key}").collect():
        out[r.cx, r.cy] = True
    return out


def disc(k):
    n = int(k)
    return [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1) if i * i + j * j <= k * k]


def moved(mask, k, every):
    n = int(k)
    wide = np.pad(mask, n)
    layers = [wide[n + i : n + i + len(mask), n + j : n + j + len(mask)] for i, j in disc(k)]
    return np.all(layers, axis=0) if every else np.any(layers, axis=0)


def flood(mask):
    label, count = np.zeros(mask.shape, int), 0
    for s in zip(*np.nonzero(mask)):
        if label[s]:
            continue
        count += 1
        stack = [s]
        label[s] = count
        while stack:
            i, j = stack.pop()
            for t in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if 0 <= t[0] < len(mask) and 0 <= t[1] < len(mask) and mask[t] and not label[t]:
                    label[t] = count
                    stack.append(t)
    return label


@pytest.mark.parametrize("k", [1, 1.5, 2.9])
def test_opening_by_a_disc(spark, k):
    masks = {1: mask_of(1, p=0.97), 2: mask_of(2, p=0.9), 3: np.ones((26, 26), bool)}
    masks[3][10:12, 4:20] = False
    runs = frame(spark, masks)
    opened = R.opening(runs, ["k"], k).cache()
    for key, m in masks.items():
        inner = moved(m, k, True)
        inner[: int(k)] = inner[-int(k) :] = inner[:, : int(k)] = inner[:, -int(k) :] = False
        assert (back(opened, key, 26) == moved(inner, k, False)).all()


def test_parts_equal_flood_fill(spark):
    masks = {1: mask_of(5, p=0.55), 2: mask_of(6, p=0.4)}
    got = R.parts(frame(spark, masks), ["k"]).collect()
    for key, m in masks.items():
        label, seen = flood(m), {}
        for r in got:
            if r.k == key:
                for cy in range(r.lo, r.hi + 1):
                    seen.setdefault(r.part, set()).add(label[r.cx, cy])
        assert sorted(next(iter(s)) for s in seen.values()) == list(range(1, label.max() + 1))
        assert all(len(s) == 1 for s in seen.values())


def test_holes_equal_flood_fill_from_outside(spark):
    masks = {1: mask_of(7, p=0.62), 2: mask_of(8, p=0.7), 3: np.ones((26, 26), bool)}
    masks[3][3:20, 3:20] = False
    masks[3][6:17, 6:17] = True
    masks[3][9:11, 9:11] = False  # a hole in an island in a hole
    runs = frame(spark, masks).cache()
    got = {(r.k, r.cx, cy): r.n_cells for r in R.holes(runs, ["k"]).collect() for cy in range(r.lo, r.hi + 1)}
    want = {}
    for key, m in masks.items():
        label = flood(~np.pad(m, 1))
        sizes = np.bincount(label.ravel())
        for i, j in zip(*np.nonzero((label > 0) & (label != label[0, 0]))):
            want[key, i - 1, j - 1] = sizes[label[i, j]]
    assert got == want
    filled = R.fill_holes(runs, ["k"], 4)
    for key, m in masks.items():
        small = m.copy()
        for (k, i, j), n in want.items():
            if k == key and n <= 4:
                small[i, j] = True
        assert (back(filled, key, 26) == small).all()


def test_an_outline_of_a_thousand_million_cells_is_runs(spark):
    big = spark.createDataFrame([(1, x, 0, 1_000_000) for x in range(1000)] + [(1, 1000, 0, 9)] + [(1, 1002, 0, 9)], "k int, cx int, lo int, hi int")
    sizes = R.size_of(R.parts(big, ["k"]), ["k", "part"]).collect()
    assert sorted(r.n_cells for r in sizes) == [10, 1_000_001_010]


def test_runs_of_cells_pass_on_their_ends_only(spark):
    """one sort along the columns; repeated, single and negative cells, and holes of one."""
    rng = np.random.default_rng(12)
    cells = [(k, int(x), int(y)) for k in range(3) for x, y in rng.integers(-6, 6, (70, 2))]
    df = spark.createDataFrame([*cells, *cells[:40]], "k int, cx int, cy int")
    runs = R.runs_of(df, ["k"])
    got = [(r.k, r.cx, y) for r in runs.collect() for y in range(r.lo, r.hi + 1)]
    assert sorted(got) == sorted(set(cells))
    apart = {(k, x, y) for k, x, y in set(cells) if (k, x, y - 1) not in set(cells)}
    assert {(r.k, r.cx, r.lo) for r in runs.collect()} == apart and runs.count() == len(apart)
    assert "Generate" not in runs._jdf.queryExecution().optimizedPlan().toString()
