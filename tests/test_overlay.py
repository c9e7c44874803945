"""Exact overlay against clipping of convex polygons and closed forms."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from landgauge.operators import cells as K
from landgauge.operators import overlay as O

RINGS = "gid int, rings array<array<struct<x: double, y: double>>>"


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def frame(spark, shapes):
    """{gid: points of an outer ring, or (outer, *holes)}"""
    rows = [(g, [ring(r) for r in (s if isinstance(s[0][0], (list, tuple)) else [s])]) for g, s in shapes.items()]
    return spark.createDataFrame(rows, RINGS)


def area(points):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, [*points[1:], points[0]])) / 2 if points else 0.0


def clip(points, other):
    """The part of a convex polygon inside another, both counter-clockwise."""
    for a, b in zip(other, [*other[1:], other[0]]):
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        out = []
        for p, q in zip(points, [*points[1:], points[0]] if points else []):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if sp * sq < 0:
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        points = out
    return points


def union_area(shapes):
    """By inclusion and exclusion; the parts shared by convex shapes are convex."""
    total = 0.0
    for n in range(1, len(shapes) + 1):
        for some in itertools.combinations(shapes, n):
            part = some[0]
            for s in some[1:]:
                part = clip(part, s)
            total += (-1) ** (n + 1) * area(part)
    return total


def convex(rng, spread=300, r=120, whole=False):
    cx, cy, n = rng.uniform(0, spread), rng.uniform(0, spread), rng.randint(3, 7)
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    points = [(cx + r * math.cos(t), cy + r * math.sin(t)) for t in angles]
    return [(float(round(x, -1)), float(round(y, -1))) for x, y in points] if whole else points


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


@pytest.mark.parametrize(("whole", "cell"), [(False, 37.0), (True, 20.0), (False, 400.0)])
def test_pairs_and_unions_of_convex_polygons(spark, whole, cell):
    rng = random.Random(int(cell))
    shapes = {i: convex(rng, whole=whole) for i in range(12)}
    shapes = {i: s for i, s in shapes.items() if area(s) > 1 and math.isclose(area(clip(s, s)), area(s))}
    frags = O.fragments(frame(spark, shapes), ["gid"], cell).cache()
    got = {r.gid: r.area for r in O.areas(frags, ["gid"]).collect()}
    assert got == pytest.approx({i: area(s) for i, s in shapes.items()})
    pairs = O.overlap_areas(frags, ["gid"], frags.withColumnRenamed("gid", "other"), ["other"], cell)
    want = {(i, j): area(clip(s, t)) for i, s in shapes.items() for j, t in shapes.items()}
    want = {k: v for k, v in want.items() if v > 1e-6 * cell * cell}
    assert {(r.gid, r.other): r.area for r in pairs.collect() if r.area > 1e-6 * cell * cell} == pytest.approx(want)
    groups = frags.withColumn("g", F.col("gid") % 4)
    unions = {r.g: r.area for r in O.total(O.union(groups, ["g"], cell), ["g"]).collect()}
    assert unions == pytest.approx({g: union_area([s for i, s in shapes.items() if i % 4 == g]) for g in unions})
    blockers = [shapes[i] for i in list(shapes)[:4]]
    left = {r.gid: r.area for r in O.total(O.difference(frags, frags.filter(F.col("gid").isin(*list(shapes)[:4])).drop("gid"), ["gid"], cell), ["gid"]).collect()}
    for i, s in shapes.items():
        assert left.get(i, 0.0) == pytest.approx(union_area([*blockers, s]) - union_area(blockers), abs=1e-6)


def test_holes_touching_shapes_and_disjoint_shapes_in_one_cell(spark):
    shapes = {
        1: (box(3, 3, 97, 97), box(20, 20, 40, 60)),
        2: box(97, 3, 140, 97),
        3: box(25, 25, 35, 50),
        4: [(0, 0), (3, 0), (0, 3)],
        5: [(6, 6), (3, 6), (6, 3)],
    }
    for cell in (10.0, 7.0, 1000.0):
        frags = O.fragments(frame(spark, shapes), ["gid"], cell)
        pairs = {(r.gid, r.other): r.area for r in O.overlap_areas(frags, ["gid"], frags.withColumnRenamed("gid", "other"), ["other"], cell).collect()}
        assert set(pairs) == {(i, i) for i in range(1, 6)} | {(1, 5), (5, 1)}
        assert pairs[1, 1] == pytest.approx(94 * 94 - 20 * 40) and pairs[1, 5] == pytest.approx(4.5)


def test_whole_cells_are_ranges(spark):
    frags = O.fragments(frame(spark, {1: box(5, 5, 100_005, 99_995)}), ["gid"], 100.0)
    assert frags.filter("full").count() == 999 and frags.count() < 14_000
    assert O.areas(frags, ["gid"]).first().area == pytest.approx(100_000 * 99_990)


def polygon_disc(r, sides=32):
    return sides / 2 * r * r * math.sin(2 * math.pi / sides)


@pytest.mark.parametrize("width", [4.0, 9.0, 15.0])
def test_standoff_of_rectangles_and_lines_inside_a_cell(spark, width):
    """Widths far below the cell size change the area as they should."""
    shapes = frame(spark, {1: box(130, 150, 520, 230), 2: box(1037, 41, 1057, 61)})
    grown = O.standoff(shapes, ["gid"], width).unionByName(shapes)
    got = {r.gid: r.area for r in O.total(O.union(O.fragments(grown, ["gid"], 100.0), ["gid"], 100.0), ["gid"]).collect()}
    for gid, (w, h) in {1: (390, 80), 2: (20, 20)}.items():
        assert got[gid] == pytest.approx(w * h + 2 * width * (w + h) + polygon_disc(width), rel=1e-9)
    line = spark.createDataFrame([(7, [[{"x": 0.0, "y": 0.0}, {"x": 300.0, "y": 0.0}, {"x": 300.0, "y": 400.0}]])], RINGS)
    got = O.total(O.union(O.fragments(O.standoff(line, ["gid"], width), ["gid"], 100.0), ["gid"], 100.0), ["gid"]).first().area
    # both arms and a disc for the ends; the inner corner counts once, a quarter of a disc fills the outer one
    assert got == pytest.approx(2 * width * 700 - width * width + polygon_disc(width) * 5 / 4, rel=1e-6)
    assert O.standoff(shapes, ["gid"], F.lit(0.0)).count() == 0


def test_one_key_may_hold_many_overlapping_shapes(spark):
    pile = frame(spark, {i: box(10 + i, 10, 60 + i, 60) for i in range(30)})
    one = O.fragments(pile.withColumn("k", F.lit(1)).drop("gid"), ["k"], 25.0)
    assert O.total(O.union(one, ["k"], 25.0), ["k"]).first().area == pytest.approx(79 * 50)
    cut = O.difference(O.fragments(frame(spark, {9: box(0, 0, 100, 100)}), ["gid"], 25.0), one.drop("k"), ["gid"], 25.0)
    assert O.total(cut, ["gid"]).first().area == pytest.approx(10_000 - 79 * 50)


def test_standoff_adds_only_what_the_rectangles_leave(spark):
    """sectors instead of discs where both edges are long enough; a ring's turn is summed up once, not per edge."""
    square = spark.createDataFrame([(1, [[{"x": float(x), "y": float(y)} for x, y in ((0, 0), (90, 0), (90, 90), (0, 90), (0, 0))]])], RINGS)
    shapes = O.standoff(square, ["gid"], 8.0)
    assert sorted(len(r.rings[0]) for r in shapes.collect()) == [5] * 4 + [11] * 4
    zigzag = [(0, 0), (40, 30), (45, 30), (10, 80), (60, 60), (20, 30), (25, 95)]
    line = spark.createDataFrame([(1, [[{"x": float(x), "y": float(y)} for x, y in zigzag]])], RINGS)
    discs = line.select("gid", F.explode(F.col("rings")[0]).alias("p")).select("gid", F.array(O.disc_ring(F.col("p.x"), F.col("p.y"), F.lit(8.0))).alias("rings"))
    area = lambda df: O.total(O.union(O.fragments(df, ["gid"], 50.0), ["gid"], 50.0), ["gid"]).first().area
    lean = O.standoff(line, ["gid"], 8.0)
    assert area(lean) == pytest.approx(area(lean.unionByName(discs)), rel=1e-9)
    plan = K.ring_edges(square, ["gid"])._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and "aggregate(" not in plan[: plan.index("explode(_edges")]


def test_heights_of_a_pair_are_worked_out_once(spark):
    """one long expression per pair of pieces repeated each height many times and was too long to be compiled."""
    rng = random.Random(4)
    rows = [tuple(rng.uniform(0, 4) if i % 2 else rng.uniform(0, 10) for i in range(8)) for _ in range(200)]
    rows = [(min(a, c), b, max(a, c), d, min(e, g), f, max(e, g), h) for a, b, c, d, e, f, g, h in rows]
    met = spark.createDataFrame(rows, ", ".join(f"{s}_{c} double" for s in "ab" for c in ("xa", "ya", "xb", "yb")))
    out = O._area_below_both(met)
    plan = out.select("_both")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("greatest(a_xa") <= 2 and plan.count("least(a_xb") <= 2
    for r in out.collect():
        n, x0, x1 = 2000, max(r.a_xa, r.b_xa), min(r.a_xb, r.b_xb)
        at = lambda s, x: r[f"{s}_ya"] + (r[f"{s}_yb"] - r[f"{s}_ya"]) * (x - r[f"{s}_xa"]) / (r[f"{s}_xb"] - r[f"{s}_xa"])
        xs = [x0 + (x1 - x0) * (i + 0.5) / n for i in range(n)]
        assert r["_both"] == pytest.approx(sum(min(at("a", x), at("b", x)) for x in xs) * (x1 - x0) / n, rel=1e-4, abs=1e-6)


def test_unions_and_sums_are_made_once_for_all_that_meet_them(spark, monkeypatch):
    """covered areas come from one union of b, not one per polygon of a; sums over b make no row per pair."""
    rng = random.Random(11)

    def star(r):
        x, y = rng.uniform(0, 300), rng.uniform(0, 300)
        arms = [(2 * math.pi * i / 9, r * rng.uniform(0.3, 1)) for i in range(9)]
        return [(x + q * math.cos(t), y + q * math.sin(t)) for t, q in arms]

    some = lambda n, r: {i: star(r) for i in range(n)}
    a = O.fragments(frame(spark, some(6, 90)), ["gid"], 40.0)
    b = frame(spark, some(14, 70)).select((F.col("gid") % 2).alias("kind"), F.col("gid").alias("bid"), "rings")
    once = O.fragments(b, ["kind", "bid"], 40.0)
    b = O.fragments(b.unionByName(b.filter("bid < 5")), ["kind", "bid"], 40.0)  # some of them twice
    one = lambda df: {tuple(r)[:-1]: r.area for r in df.collect()}
    spread = O.spread(b, ["kind"], a, ["gid"])
    mine = a.join(spread.select("gid", "kind").distinct(), "gid")
    both = O.combine(mine, spread, ["gid", "kind"], 40.0).withColumn("area", F.col("both"))
    want = one(O.total(both, ["gid", "kind"]))
    monkeypatch.setattr(O, "combine", None)
    for apart in (True, False):
        got = one(O.covered_by(a, ["gid"], b, ["kind"], 40.0, apart))
        assert got == {k: pytest.approx(v, rel=1e-6, abs=1e-6) for k, v in want.items() if v > 1e-5}
    single = O.fragments(frame(spark, {1: box(11, 13, 150, 170)}), ["gid"], 40.0)
    assert one(O.covered_by(single.unionByName(single), ["gid"], single.drop("gid"), [], 40.0)) == {(1,): pytest.approx(139 * 157)}
    assert one(O.overlap_sums(single, ["gid"], single.unionByName(single).withColumnRenamed("gid", "k"), ["k"], 40.0)) == {(1, 1): pytest.approx(2 * 139 * 157)}
    pairs = one(O.overlap_areas(a, ["gid"], once, ["kind", "bid"], 40.0).groupBy("gid", "kind").agg(F.sum("area").alias("area")))
    assert one(O.overlap_sums(a, ["gid"], once, ["kind"], 40.0)) == {k: pytest.approx(v, rel=1e-6, abs=1e-6) for k, v in pairs.items()}


def test_what_is_cut_away_is_one_shape_first(spark, monkeypatch):
    """F16: overlapping shapes reach each polygon as their union, not all one by one."""
    pile = O.fragments(frame(spark, {i: box(10 + i, 10, 60 + i, 60) for i in range(30)}), ["gid"], 25.0)
    met, plain = [], O.spread
    monkeypatch.setattr(O, "spread", lambda frags, *rest: met.append(frags.count()) or plain(frags, *rest))
    cut = O.difference(O.fragments(frame(spark, {9: box(0, 0, 100, 100)}), ["gid"], 25.0), pile.drop("gid"), ["gid"], 25.0)
    assert O.total(cut, ["gid"]).first().area == pytest.approx(10_000 - 79 * 50)
    assert met[0] < pile.count() * 0.6
