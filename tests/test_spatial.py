"""Cell algebra and spatial joins against brute force on random shapes."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from landgauge.functions import geometry as G
from landgauge.operators import cells as K
from landgauge.operators import spatial as S

RINGS = "gid int, rings array<array<struct<x:double,y:double>>>"


def star(cx, cy, n, r, rng):
    """A concave star-shaped ring."""
    ang = np.sort(rng.random(n) * 2 * math.pi)
    rad = r * (0.3 + 0.7 * rng.random(n))
    pts = [(cx + q * math.cos(a), cy + q * math.sin(a)) for a, q in zip(ang, rad)]
    return [*pts, pts[0]]


def shoelace(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))) / 2


def inside(ring, x, y):
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (x1 <= x) != (x2 <= x) and y1 + (y2 - y1) * (x - x1) / (x2 - x1) > y:
            hit = not hit
    return hit


def stars(spark, count=12, seed=1):
    rng = np.random.default_rng(seed)
    rings = [star(rng.random() * 2000, rng.random() * 2000, 14, 500, rng) for _ in range(count)]
    # half of them run clockwise
    rings = [r if i % 2 else r[::-1] for i, r in enumerate(rings)]
    hole = [(0, 0), (0, 30), (30, 30), (30, 0), (0, 0)]
    rows = []
    for i, r in enumerate(rings):
        shape = [r]
        if i == 0:
            mx, my = np.mean([p[0] for p in r[:-1]]), np.mean([p[1] for p in r[:-1]])
            shape.append([(mx - 15 + a, my - 15 + b) for a, b in hole])
        rows.append((i, [[{"x": float(a), "y": float(b)} for a, b in ring] for ring in shape]))
    return rings, rows, spark.createDataFrame(rows, RINGS)


def test_cover_area_is_exact_for_any_polygon(spark):
    rings, rows, df = stars(spark)
    for cell in (40.0, 333.0):
        got = {r.gid: r.a for r in K.cover(df, ["gid"], cell).groupBy("gid").agg(F.sum("area").alias("a")).collect()}
        for i, shape in rows:
            want = shoelace([(p["x"], p["y"]) for p in shape[0]]) - sum(shoelace([(p["x"], p["y"]) for p in h]) for h in shape[1:])
            assert math.isclose(got[i], want, rel_tol=1e-6)
    area = {r.gid: r.a for r in df.select("gid", G.ring_area(F.col("rings")).alias("a")).collect()}
    assert math.isclose(area[1], shoelace(rings[1]), rel_tol=1e-9)


def test_points_in_polygons_equal_ray_casting(spark):
    _, rows, df = stars(spark)
    rng = np.random.default_rng(5)
    pts = pd.DataFrame({"pid": range(600), "x": rng.random(600) * 2600 - 300, "y": rng.random(600) * 2600 - 300})
    pts.loc[:200, ["x", "y"]] = pts.loc[0, ["x", "y"]].to_list()  # a pile of copies
    got = {tuple(r) for r in S.points_in_polygons(spark.createDataFrame(pts), "pid", df, "gid", 90.0).collect()}
    want = set()
    for i, shape in rows:
        polys = [[(p["x"], p["y"]) for p in ring] for ring in shape]
        for p in pts.itertuples():
            if sum(inside(ring, p.x, p.y) for ring in polys) % 2:
                want.add((p.pid, i))
    assert got == want


def test_candidates_are_settled_where_they_are_met(spark, monkeypatch):
    """No candidate is shuffled to its edges, pairs bring both sides' columns; long columns of edges give the same."""
    _, _, df = stars(spark)
    df = df.withColumn("size", F.col("gid") % 3).withColumn("note", F.when(F.col("gid") % 2 == 0, "even"))
    rng = np.random.default_rng(6)
    pts = spark.createDataFrame(pd.DataFrame({"pid": range(400), "x": rng.random(400) * 2000, "y": rng.random(400) * 2000})).withColumn("w", F.col("pid") * 2)
    ask = lambda: S.points_in_polygons(pts, "pid", df, "gid", 90.0, cols=["size", "note"], p_cols=["w"])
    pairs = ask()
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan
    got = {tuple(r) for r in pairs.select("pid", "gid", "w", "size", "note").collect()}
    assert got and all(w == 2 * p and s == g % 3 and n == ("even" if g % 2 == 0 else None) for p, g, w, s, n in got)
    monkeypatch.setattr(S, "MOST_EDGES", 3)
    assert {tuple(r) for r in ask().select("pid", "gid", "w", "size", "note").collect()} == got
    least = {(r.pid, r.gid) for r in S.containing_area(pairs, "pid", df, "gid", [], "size").collect()}
    assert least == {(p, min((s, g) for q, g, _, s, _ in got if q == p)[1]) for p, *_ in got}


def cloud(seed, n, spread=40_000):
    rng = np.random.default_rng(seed)
    xy = rng.random((n, 2)) * spread
    xy[: n // 3] = xy[0]  # a third at one spot
    xy[n // 3 : n // 2] = xy[n // 3] + rng.random((n // 2 - n // 3, 2)) * 50  # a dense knot
    return xy


def test_nearest_equals_brute_force(spark):
    a, b = cloud(1, 150), cloud(2, 240)
    adf = spark.createDataFrame(pd.DataFrame({"sid": range(len(a)), "sx": a[:, 0], "sy": a[:, 1]}))
    bdf = spark.createDataFrame(pd.DataFrame({"id": range(len(b)), "x": b[:, 0], "y": b[:, 1]}))
    for k, cap in ((1, 6000.0), (8, 30_000.0)):
        got = S.nearest(adf, "sid", bdf, "id", cap, k).toPandas()
        for i, p in enumerate(a):
            d = np.hypot(*(b - p).T)
            want = [(round(x, 6), j) for x, j in sorted(zip(d, range(len(b)))) if x <= cap][:k]
            mine = got[got.sid == i].sort_values("nn_rank")
            assert [(round(x, 6), j) for x, j in zip(mine.dist, mine.id)] == want


def test_catchment_totals_equal_brute_force(spark):
    a, b = cloud(3, 60), cloud(4, 400)
    w = np.arange(len(b), dtype=float)
    adf = spark.createDataFrame(pd.DataFrame({"sid": range(len(a)), "sx": a[:, 0], "sy": a[:, 1]}))
    bdf = spark.createDataFrame(pd.DataFrame({"w": w, "x": b[:, 0], "y": b[:, 1]}))
    radii = [700, 2500, 9000]
    got = S.catchment_totals(adf, "sid", bdf, radii, {"n": F.lit(1), "w": F.col("w")}).toPandas().sort_values("sid")
    for r in radii:
        near = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1]) <= r
        assert got[f"n_{r}"].tolist() == near.sum(1).tolist()
        assert np.allclose(got[f"w_{r}"], near @ w)


def test_projection_reference_point(spark):
    """The published worked example of the national grid: 52 39 27.2531 N, 1 43 4.5177 E (Airy)."""
    df = spark.createDataFrame([(1 + 43 / 60 + 4.5177 / 3600, 52 + 39 / 60 + 27.2531 / 3600)], "lng double, lat double")
    r = G.airy_to_grid(df, "lng", "lat").first()
    assert abs(r.e - 651409.903) < 0.01 and abs(r.n - 313177.270) < 0.01
    back = G.grid_to_airy(spark.createDataFrame([(651409.903, 313177.270)], "e double, n double"), "e", "n").first()
    assert abs(back.lat - (52 + 39 / 60 + 27.2531 / 3600)) < 1e-7


def test_full_cells_are_split_by_their_count(spark):
    """Half of all points on one spot: no part holds much more than its share, and the joins stay what they were."""
    rng = np.random.default_rng(9)
    xy = rng.random((2000, 2)) * 30_000
    xy[:1000] = 15_000.0
    b = spark.createDataFrame(pd.DataFrame({"id": range(2000), "x": xy[:, 0], "y": xy[:, 1]}))
    a = spark.createDataFrame(pd.DataFrame({"sid": range(40), "sx": xy[980:1020, 0] + 7.0, "sy": xy[980:1020, 1]}))
    plain = {tuple(r) for r in S.within_distance(a, b, 900.0).select("sid", "id").collect()}
    inside = S.catchment_totals(a, "sid", b, [900], {"n": F.lit(1)}).orderBy("sid").collect()
    near = S.nearest(a, "sid", b, "id", 4000.0, 3).orderBy("sid", "nn_rank").collect()
    spark.conf.set(S.LEAF_CONF, "25")
    try:
        rows, probe = S.split_full(b.withColumn("cx", F.floor(F.col("x") / 900)), a.withColumn("cx", F.floor(F.col("sx") / 900)), ["cx"], ["id"])
        sizes = [r[0] for r in rows.groupBy("cx", "_part").count().select("count").collect()]
        assert max(sizes) <= 2 * 25 and probe.groupBy("sid").count().agg(F.max("count")).first()[0] >= 40
        assert {tuple(r) for r in S.within_distance(a, b, 900.0).select("sid", "id").collect()} == plain
        assert S.catchment_totals(a, "sid", b, [900], {"n": F.lit(1)}).orderBy("sid").collect() == inside
        assert S.nearest(a, "sid", b, "id", 4000.0, 3).orderBy("sid", "nn_rank").collect() == near
    finally:
        spark.conf.unset(S.LEAF_CONF)


def test_a_side_that_explodes_is_not_broadcast_by_its_estimate(spark, tmp_path):
    """files of a few KB become 9 rows or hundreds of cells each, which an estimate does not see."""
    from landgauge.operators.linkage import keyed_nearest

    spark.range(2000).selectExpr("id", "id % 10 as road", "cast(id % 97 * 50 as double) as x", "cast(id % 89 * 50 as double) as y").write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    boxes = p.select("id", G.rect_rings(F.col("x"), F.col("y"), F.col("x") + 300, F.col("y") + 300).alias("rings"))
    links = p.select(F.col("id").alias("link"), "road", F.col("x").alias("lx"), F.col("y").alias("ly"))
    for df in (
        S.within_distance(p.select("id", F.col("x").alias("sx"), F.col("y").alias("sy")), p.select("x", "y"), 100.0),
        S.points_in_polygons(p.select(F.col("id").alias("pid"), "x", "y"), "pid", boxes, "id", 50.0),
        keyed_nearest(links, p.withColumnRenamed("id", "point"), "link", "point", "road", F.lit(100.0)),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "BroadcastExchange" not in plan


def test_joins_are_dealt_by_their_pairs_and_lose_none(spark):
    """all rows in one cell, few bytes: the pairs tell how many parts and tasks there are."""
    a = spark.range(300).selectExpr("id as sid", "cast(id % 7 as double) as sx", "cast(id % 5 as double) as sy")
    b = spark.range(500).selectExpr("id", "cast(id % 11 as double) as x", "cast(id % 3 as double) as y")
    want = S.within_distance(a, b, 50.0).groupBy("sid").count().collect()
    assert len(want) == 300 and {r["count"] for r in want} == {500}
    spark.conf.set("landgauge.leafPairs", "5000")
    try:
        rows, probe = S.split_full(b.withColumn("cx", F.lit(1)), a.withColumn("cx", F.lit(1)), ["cx"], ["id"])
        assert rows.select("_part").distinct().count() == 30 and probe.count() == 30 * 300
        met = S.within_distance(a, b, 50.0)
        assert met.count() == 150_000 and met.select("sid", "id").distinct().count() == 150_000
        busy = rows.join(probe, ["cx", "_part"]).groupBy(F.spark_partition_id()).count().collect()
        assert len(busy) >= 15 and max(r["count"] for r in busy) <= 150_000 / 5
    finally:
        spark.conf.unset("landgauge.leafPairs")


def test_what_explodes_is_dealt_over_tasks_first(spark, tmp_path):
    """A small file is read by one task, which would hold all that its rows become."""
    from landgauge.operators import cells as K

    spark.range(500).selectExpr("id", "cast(id % 97 * 50 as double) as x", "cast(id % 89 * 50 as double) as y").coalesce(1).write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    boxes = p.select("id", G.rect_rings(F.col("x"), F.col("y"), F.col("x") + 300, F.col("y") + 300).alias("rings"))
    assert p.rdd.getNumPartitions() == 1
    for df in (K.ring_edges(boxes, ["id"]), K.disc_cells(p, ["id"], F.col("x"), F.col("y"), 200.0, 50.0)):
        busy = df.groupBy(F.spark_partition_id()).count().collect()
        assert len(busy) == 8 and max(r["count"] for r in busy) < 0.3 * df.count()


def test_cells_round_an_origin_are_listed_once(spark):
    """totals of whole cells and of single points listed them each, with a root per radius and cell."""
    rng = np.random.default_rng(11)
    # origins and points on corners and borders of cells, where rounding would show
    a, b = rng.integers(-20, 20, (40, 2)) * 250.0, rng.integers(-20, 20, (600, 2)) * 125.0
    adf = spark.createDataFrame(pd.DataFrame({"sid": range(len(a)), "sx": a[:, 0], "sy": a[:, 1]}))
    bdf = spark.createDataFrame(pd.DataFrame({"x": b[:, 0], "y": b[:, 1]}))
    radii = [250, 500, 1250, 1500]
    out = S.catchment_totals(adf, "sid", bdf, radii, {"n": F.lit(1)})
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("explode(") == 3 and plan.count("hypot(") <= 2
    got = out.toPandas().sort_values("sid")
    for r in radii:
        assert got[f"n_{r}"].tolist() == (np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1]) <= r).sum(1).tolist()


def test_catchment_quantiles_make_no_row_per_pair_and_are_exact(spark):
    """medians and quartiles of a catchment sorted every pair of an origin and a point."""
    rng = np.random.default_rng(5)
    a, b = cloud(6, 40), cloud(7, 700)
    v = np.where(rng.random(700) < 0.1, np.nan, np.round(rng.exponential(40, 700)))  # many ties, some missing
    w = rng.random(700)
    adf = spark.createDataFrame(pd.DataFrame({"sid": range(len(a)), "sx": a[:, 0], "sy": a[:, 1]}))
    bdf = spark.createDataFrame(pd.DataFrame({"v": v, "w": w, "x": b[:, 0], "y": b[:, 1]})).withColumn("v", F.nanvl("v", F.lit(None)))
    for r in (900.0, 4000.0):
        out = S.catchment_quantiles(adf, "sid", bdf, r, {"v": F.col("v"), "w": F.col("w")}, {"p25": 0.25, "med": 0.5, "max": 1.0})
        got = {row.sid: row for row in out.collect()}
        for i in range(len(a)):
            near = np.hypot(a[i, 0] - b[:, 0], a[i, 1] - b[:, 1]) <= r
            for name, x in (("v", v[near]), ("w", w[near])):
                x = x[~np.isnan(x)]
                if i not in got:
                    assert not near.any() or not len(x)
                    continue
                assert got[i][f"{name}_n"] == len(x)
                for p, q in (("p25", 0.25), ("med", 0.5), ("max", 1.0)):
                    want = np.quantile(x, q) if len(x) else None
                    assert got[i][f"{name}_{p}"] == want or abs(got[i][f"{name}_{p}"] - want) < 1e-9


def test_nearest_of_the_own_key_looks_beyond_4_km(spark):
    """the reach that is asked for counts, whatever it is, and each link meets points of its own key only."""
    from landgauge.operators.linkage import keyed_nearest

    rng = np.random.default_rng(9)
    links = pd.DataFrame({"link": range(120), "road": [i % 4 for i in range(120)], "lx": rng.random(120) * 60_000, "ly": rng.random(120) * 60_000})
    points = pd.DataFrame({"point": range(90), "road": [i % 5 for i in range(90)], "x": rng.random(90) * 60_000, "y": rng.random(90) * 60_000})
    reach = F.when(F.col("link") % 2 == 0, 9000.0).otherwise(2000.0)
    got = {(r.link, r.point): r.dist for r in keyed_nearest(spark.createDataFrame(links), spark.createDataFrame(points), "link", "point", "road", reach).collect()}
    want = {}
    for a in links.itertuples():
        far = sorted((math.hypot(a.lx - b.x, a.ly - b.y), b.point) for b in points.itertuples() if a.road == b.road)
        if far and far[0][0] <= (9000 if a.link % 2 == 0 else 2000):
            want[a.link, far[0][1]] = far[0][0]
    assert any(d > 4000 for d in want.values())
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in got)


def test_sums_and_largest_of_catchments_without_pairs(spark):
    """sums per group and the largest of a circle, against all pairs."""
    rng = np.random.default_rng(10)
    o = pd.DataFrame({"sid": range(25), "sx": rng.random(25) * 9000, "sy": rng.random(25) * 9000})
    p = pd.DataFrame({"id": range(700), "x": rng.random(700) * 9000, "y": rng.random(700) * 9000, "kind": [f"k{i % 3}" for i in range(700)], "cap": rng.integers(0, 12, 700)})
    p.loc[:150, ["x", "y"]] = [4000.0, 4000.0]
    origins, points = spark.createDataFrame(o), spark.createDataFrame(p)
    sums = S.catchment_sums_by(origins, "sid", points, {"n": F.lit(1), "cap": F.col("cap")}, [("n", 700), ("n", 2500), ("cap", 2500)], ["kind"])
    top = S.largest_within(origins, "sid", points, "id", "cap", 2500.0, 5)
    got = {(r.sid, r.kind): (r.n_700 or 0, r.n_2500, r.cap_2500) for r in sums.collect()}
    best = {(r.sid, r.rk): r.id for r in top.collect()}
    want, first = {}, {}
    for a in o.itertuples():
        near = [(b, math.hypot(a.sx - b.x, a.sy - b.y)) for b in p.itertuples()]
        near = [(b, d) for b, d in near if d <= 2500]
        for b, d in near:
            n, m, c = want.get((a.sid, b.kind), (0, 0, 0))
            want[a.sid, b.kind] = (n + (d <= 700), m + 1, c + b.cap)
        for i, b in enumerate(sorted((b for b, _ in near), key=lambda b: (-b.cap, b.id))[:5]):
            first[a.sid, i + 1] = b.id
    assert got == want and best == first


def test_a_search_meets_few_candidates_and_shuffles_no_pairs(spark):
    """cells are as small as k asks for, and each row of a keeps k pairs before anything is shuffled."""
    rng = np.random.default_rng(21)
    b = rng.random((4000, 2)) * 60_000
    a = rng.random((200, 2)) * 60_000
    adf = spark.createDataFrame(pd.DataFrame({"sid": range(len(a)), "sx": a[:, 0], "sy": a[:, 1]}))
    bdf = spark.createDataFrame(pd.DataFrame({"id": range(len(b)), "x": b[:, 0], "y": b[:, 1], "cost": b[:, 0] % 7}))
    lost = spark.createDataFrame([(9000, float("nan"), 5.0, 0.0), (9001, None, 5.0, 0.0)], bdf.schema)
    sites = bdf.select("id", F.col("x").alias("_bx"), F.col("y").alias("_by"))
    cell = 30_000 / 2 ** (S._levels(sites, 30_000.0, 8) - 1)
    assert np.unique(np.floor(b / cell), axis=0, return_counts=True)[1].max() <= 4
    near = S.nearest(adf, "sid", bdf.unionByName(lost), "id", 30_000.0, 8)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # the first of them in the task that makes the pairs
    got = near.toPandas()
    for i, p in enumerate(a):
        d = np.hypot(b[:, 0] - p[0], b[:, 1] - p[1])
        assert got[got.sid == i].sort_values("nn_rank").id.tolist() == np.argsort(d, kind="stable")[:8].tolist()


def test_merge_makes_no_pairs_and_minds_names_without_words(spark, monkeypatch):
    """the lowest id that shares a word comes from a bounded search; names that are null or have no long word as before."""
    from landgauge.operators import linkage as L

    monkeypatch.setattr(L, "within_distance", None)
    rng = np.random.default_rng(14)
    names = ["Small ring", "red bolt", "blue ring bolt", "a b", "gear", None, "", "RED gear"]
    schema = "id long, name string, x double, y double, status string, opened string, tags array<string>"

    def side(n, tag):
        return [(int(i) + 100, names[int(k)], float(x), float(y), "proposed", None, [tag]) for i, k, (x, y) in zip(rng.permutation(n), rng.integers(0, 8, n), rng.random((n, 2)) * 900)]

    a, b = side(120, "a"), side(80, "b")
    words = lambda s: None if s is None else {w for w in s.lower().split() if len(w) > 3}

    def alike(p, q):
        u, v = words(p), words(q)
        return u == set() or v == set() or bool(u and v and u & v)

    want = {}
    for q in b:
        near = [p[0] for p in a if math.hypot(p[2] - q[2], p[3] - q[3]) <= 90 and alike(p[1], q[1])]
        if near:
            want[min(near)] = want.get(min(near), 0) + 1
    got = L.merge_nearby(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 90.0).collect()
    assert {r.id for r in got if r.source == "both"} == set(want)
    assert sum(r.source == "b" for r in got) == len(b) - sum(want.values())
