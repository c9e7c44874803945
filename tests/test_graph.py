"""Iterative operators against plain Python."""

import heapq
import itertools
import math

import numpy as np
import pandas as pd
import pytest

from landgauge.operators import graph as GR


def random_edges(seed, n=40, m=70):
    rng = np.random.default_rng(seed)
    e = {(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2)) if a != b}
    return [(a, b, float(c)) for (a, b), c in zip(sorted(e), rng.integers(1, 9, len(e)))]


def dijkstra(edges, src):
    adj = {}
    for u, v, c in edges:
        adj.setdefault(u, []).append((v, c))
    dist, heap = {}, [(0.0, src)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in dist:
            continue
        dist[u] = d
        for v, c in adj.get(u, ()):
            heapq.heappush(heap, (d + c, v))
    return dist


def test_shortest_times(spark):
    edges = random_edges(1)
    df = spark.createDataFrame(edges, "u long, v long, cost double")
    got = {r.node: r.dist for r in GR.shortest_times(df, spark.createDataFrame([(0, 0.0)], "node long, dist double")).collect()}
    assert got == dijkstra(edges, 0)


def test_components(spark):
    edges = [(a, b) for a, b, _ in random_edges(2, 60, 45)]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    nodes = spark.createDataFrame([(i,) for i in range(60)], "node long")
    got = {r.node: r.component for r in GR.components(spark.createDataFrame(edges, "u long, v long"), nodes).collect()}
    assert got == {i: find(i) for i in range(60)}


def test_route_and_load(spark):
    base = [(0, 1, 100.0, 1), (1, 2, 100.0, 2), (2, 3, 100.0, 3), (0, 4, 50.0, 4), (4, 3, 900.0, 5)]
    both = base + [(v, u, c, e) for u, v, c, e in base]
    edges = spark.createDataFrame(both, "u long, v long, cost double, edge long")
    pairs = spark.createDataFrame([(0, 3, 10, 280.0), (1, 3, 4, 200.0), (4, 2, 3, 1.0)], "a long, b long, trains long, straight double")
    got = {r.edge: (r.trains, r.top_a, r.top_b) for r in GR.assign_load(edges, pairs).collect()}
    assert got == {1: (13, 0, 3), 2: (17, 0, 3), 3: (14, 0, 3), 4: (3, 4, 2)}


def test_earliest_arrival_equals_connection_scan(spark):
    rng = np.random.default_rng(9)
    n = 30
    xy = rng.random((n, 2)) * 1500
    conns, budget, t0 = [], 2700, 61200
    for trip in range(25):
        t = t0 + int(rng.integers(0, 1800))
        stops = rng.permutation(n)[:5]
        for a, b in itertools.pairwise(stops):
            dt = int(rng.integers(60, 400))
            conns.append((trip, int(a), int(b), t, t + dt))
            t += dt + int(rng.integers(1, 60))
    mpm = GR.PT_WALK_MPM
    foot = {i: [(j, int(math.hypot(*(xy[i] - xy[j])) / mpm * 60)) for j in range(n) if j != i and math.hypot(*(xy[i] - xy[j])) <= 300] for i in range(n)}
    org = np.array([700.0, 700.0])
    best = {i: int(math.hypot(*(xy[i] - org)) / mpm * 60) for i in range(n) if math.hypot(*(xy[i] - org)) <= 400}
    on = set()
    for trip, a, b, td, ta in sorted(conns, key=lambda c: c[3]):
        if trip in on or best.get(a, 1 << 30) <= td - t0:
            if td - t0 > budget:
                continue
            on.add(trip)
            arr = ta - t0
            if arr <= budget and arr < best.get(b, 1 << 30):
                best[b] = arr
                for j, w in foot[b]:
                    if arr + w <= budget and arr + w < best.get(j, 1 << 30):
                        best[j] = arr + w
    stops = spark.createDataFrame(pd.DataFrame({"stop": range(n), "x": xy[:, 0], "y": xy[:, 1]}))
    got = GR.earliest_arrival(
        spark.createDataFrame([(1, 700.0, 700.0)], "origin int, x double, y double"), stops,
        spark.createDataFrame(conns, "trip int, dep long, arr long, td long, ta long"), t0, budget, access=400.0,
    )
    assert {r.stop: r.t for r in got.collect()} == best


@pytest.mark.parametrize("n", [12])
def test_contract_keeps_lengths_and_branches(spark, n):
    chain = [(i, i + 1, 1.0) for i in range(n)] + [(5, 100, 2.0), (100, 101, 3.0)]
    edges = spark.createDataFrame(chain, "u long, v long, length double")
    got = {(r.u, r.v): r.length for r in GR.contract(edges, spark.createDataFrame([(8,)], "node long")).collect()}
    assert got == {(0, 5): 5.0, (5, 8): 3.0, (8, 12): 4.0, (5, 101): 5.0}


def test_paths_of_hundreds_of_edges_are_walked_back_by_doubling(spark):
    """A chain of 700 with a branch at 300; each end gets every edge up to the origin once."""
    rows = [(0, n, n - 1 if n else None, n if n else None) for n in range(701)] + [(0, 1000 + n, 1000 + n - 1 if n else 300, 1000 + n) for n in range(50)]
    rows += [(5, 5, None, None), (5, 6, 5, 66)]
    tree = spark.createDataFrame(rows, "origin long, node long, prev long, edge long")
    ends = spark.createDataFrame([(0, 700), (0, 1), (0, 1049), (5, 6)], "a long, b long")
    got = {}
    for r in GR.paths_back(tree, ends).collect():
        got.setdefault((r.a, r.b), []).append(r.edge)
    want = {(0, 700): range(1, 701), (0, 1): [1], (0, 1049): [*range(1, 301), *range(1000, 1050)], (5, 6): [66]}
    assert {k: sorted(v) for k, v in got.items()} == {k: list(v) for k, v in want.items()}


def test_origins_meet_rides_and_no_trips(spark):
    """of all rides between two stops only those stay that a later start does not beat, whatever the number of trips."""
    rng = np.random.default_rng(31)
    conns = []
    for trip in range(300):
        t = int(rng.integers(0, 900))
        for a, b in itertools.pairwise(rng.permutation(6)[:4]):
            dt = int(rng.integers(30, 300))
            conns.append((trip, int(a), int(b), t, t + dt))
            t += dt + int(rng.integers(0, 60))
    df = spark.createDataFrame(conns, "trip int, dep long, arr long, td long, ta long")
    got = {tuple(r) for r in GR.rides(df, 1200).select("dep", "arr", "td", "ta").collect()}
    all_ = {(p[1], q[2], p[3], q[4]) for p in conns for q in conns if p[0] == q[0] and q[3] >= p[3] and q[4] <= 1200}
    assert got == {r for r in all_ if not any(o[:2] == r[:2] and (o[2] > r[2] and o[3] <= r[3] or o[2] == r[2] and o[3] < r[3]) for o in all_)}
    assert len(got) < len(all_) / 2


def test_people_in_reach_are_summed_from_runs(spark, monkeypatch):
    """discs of an origin are runs of cells; no row per origin, disc and cell is made."""
    from landgauge.operators import cells as K
    from landgauge.plans import land as LP

    monkeypatch.setattr(K, "disc_cells", None)
    rng = np.random.default_rng(8)
    reached = [(int(o), float(x), float(y), int(t)) for o, x, y, t in zip(rng.integers(0, 3, 40), rng.integers(0, 3000, 40), rng.integers(0, 3000, 40), rng.integers(0, 2700, 40))]
    people = [(float(x), float(y), float(i % 9)) for i, (x, y) in enumerate(rng.random((500, 2)) * 3000)]
    got = LP.reach_population(spark.createDataFrame(reached, "origin int, x double, y double, t int"), spark.createDataFrame(people, "x double, y double, pop double"), 2700, 100.0)
    want = {}
    for o in range(3):
        discs = [(x, y, min(1200.0, (2700 - t) / 60 * (80 / 1.3))) for q, x, y, t in reached if q == o]
        want[o] = sum(p for a, b, p in people if any(r > 60 and math.hypot((a // 100 + 0.5) * 100 - x, (b // 100 + 0.5) * 100 - y) <= r for x, y, r in discs))
    assert {r.origin: round(r.population, 6) for r in got.collect()} == {o: round(p, 6) for o, p in want.items() if p}
