"""MinHash signatures, band plans, and exact verification of candidate groups in blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgauge.llm.text import U64, mix

# a block of a candidate group holds at most about this many members and this many set elements
BLOCK_MEMBERS, BLOCK_ELEMENTS = 128, 200_000


def band_plan(threshold: float, recall: float, most: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have so that sets as alike as the
    threshold collide in some band with probability `recall`, with at most `most` hashes.

    More rows mean fewer chance collisions to verify.
    """
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


@cache
def _factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * count + 1, dtype=U64) * U64(0x632BE59BD9B4E019))
    return seeds[:count] | U64(1), seeds[count:]


def band_keys(hashes: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """int64 [units, bands]: a key per band of the MinHash signature of each unit.

    Unit i holds hashes[offsets[i]:offsets[i + 1]]; all units must hold some.
    """
    factor, shift = _factors(bands * rows)
    out = np.empty((len(offsets) - 1, bands), np.int64)
    if not len(out):
        return out
    for b in range(bands):
        key = mix(np.full(len(out), b + 1, U64))
        for k in range(b * rows, (b + 1) * rows):
            low = np.minimum.reduceat((hashes ^ shift[k]) * factor[k], offsets[:-1])
            key = mix(key ^ low)
        out[:, b] = key.view(np.int64)
    return out


def star_edges(keys: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """u, v: each node of a bucket tied to the bucket's smallest node; buckets of one node are left out.

    `keys` node, bucket; a node must be in a bucket once at most.
    """
    shared = cut(keys.groupBy("bucket").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("bucket", "v"))
    return keys.join(shared, "bucket").filter("node <> v").select(F.col("node").alias("u"), "v").distinct()


def dealt_blocks(members: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds blocks (how many its group is cut into) and b (its own) to `members` grp, node, weight, ...

    weight is the number of elements of the member's set.
    """
    sizes = cut(
        members.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"), F.sum("weight").alias("_w")).select(
            "grp", F.greatest(F.ceil(F.col("_n") / BLOCK_MEMBERS), F.ceil(F.col("_w") / BLOCK_ELEMENTS)).cast("int").alias("blocks")
        )
    )
    return members.join(sizes, "grp").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def block_pairs(members: DataFrame) -> DataFrame:
    """Copies each member of `members` (b, blocks, ...) to the pairs of blocks bi <= bj that hold its
    block, so that any two members of a group meet in one pair."""
    other = members.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select(*members.columns, F.least("b", "_o").alias("bi"), F.greatest("b", "_o").alias("bj"))


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of equal (non-null, integer) keys of a partition sorted by them, each whole."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        if rest and any(rest[-1].column(k)[-1].as_py() != c[0] for k, c in zip(keys, columns)):
            yield pa.concat_batches(rest)
            rest = []
        for a, b in zip(edges[:-1], edges[1:]):
            if b == batch.num_rows:
                rest.append(batch.slice(a, b - a))
            elif rest:
                yield pa.concat_batches([*rest, batch.slice(a, b - a)])
                rest = []
            else:
                yield batch.slice(a, b - a)
    if rest:
        yield pa.concat_batches(rest)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of a list of sorted sets."""
    m = len(sets)
    if m <= 6:
        out = np.zeros((m, m))
        for i in range(m):
            out[i, i] = len(sets[i])
            for j in range(i + 1, m):
                small, large = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                out[i, j] = out[j, i] = np.count_nonzero(large[at] == small) if len(large) else 0
        return out
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.diag([float(len(s)) for s in sets])
    common = count[place] > 1  # elements of one set alone meet nothing
    owner, place = owner[common], place[common]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    fresh = np.r_[True, place[1:] != place[:-1]] if len(place) else np.zeros(0, bool)
    column = np.cumsum(fresh) - 1
    hits = np.zeros((m, m), np.float32)
    width = 2048
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [begin, begin + width])
        block = np.zeros((m, width), np.float32)
        block[owner[a:b], column[a:b] - begin] = 1
        hits += block @ block.T
    off = ~np.eye(m, dtype=bool)
    out[off] = hits[off]
    return out


def linked(node: np.ndarray, block: np.ndarray, within: bool, sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """bool [m, m]: pairs as alike as the threshold that this pair of blocks has to judge.

    A pair of different blocks leaves pairs inside one block to that block's own group.
    """
    sizes = np.array([len(s) for s in sets], np.float64)
    both = overlaps(sets)
    union = sizes[:, None] + sizes[None, :] - both
    alike = (both > 0) & (both >= threshold * union - 1e-9)
    np.fill_diagonal(alike, False)
    if not within:
        alike &= block[:, None] != block[None, :]
    return alike & (node[:, None] != node[None, :])


def local_roots(alike: np.ndarray) -> np.ndarray:
    """Smallest member index reachable from each member."""
    root = np.arange(len(alike))
    if not alike.any():
        return root
    while True:
        low = np.where(alike, root[None, :], len(root)).min(axis=1)
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
