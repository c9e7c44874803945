"""Point and polygon joins as grid-cell equi-joins with an exact residual test; full cells are split (see splits)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgauge.operators.cells import cell_of, cover, edge_columns, ring_edges
from landgauge.operators.ordering import first_per
from landgauge.operators.overlay import areas, covered_by, overlap_areas
from landgauge.operators.splits import LEAF_CONF, split_full  # noqa: F401 - part of this module's settings
from landgauge.session import cut_lineage, spread

MOST_LEVELS = 20
BUCKETS = 32  # of values, for quantiles of catchments
MARGIN = 1e-12  # of a squared distance, well over its rounding
MOST_EDGES = 64  # of one polygon in one grid column that travel with its cells


def _around(x: Column, y: Column, cell: float, reach: int = 1) -> Column:
    span = range(-reach, reach + 1)
    cx, cy = cell_of(x, cell), cell_of(y, cell)
    return F.array(*[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in span for j in span])


def within_distance(
    a: DataFrame, b: DataFrame, r: float, a_xy: tuple[str, str] = ("sx", "sy"), b_xy: tuple[str, str] = ("x", "y")
) -> DataFrame:
    """All (a, b) pairs no more than r metres apart, with `dist`. Keep `a` the smaller side."""
    probe = spread(a).withColumn("_c", F.explode(_around(F.col(a_xy[0]), F.col(a_xy[1]), r)))
    probe = probe.select(*a.columns, F.col("_c.cx").alias("_cx"), F.col("_c.cy").alias("_cy"))
    rows = b.withColumn("_cx", cell_of(F.col(b_xy[0]), r)).withColumn("_cy", cell_of(F.col(b_xy[1]), r))
    hashed = [c for c, kind in b.dtypes if not kind.startswith("map")]
    rows, probe = split_full(rows, probe, ["_cx", "_cy"], hashed)
    gap = F.hypot(F.col(a_xy[0]) - F.col(b_xy[0]), F.col(a_xy[1]) - F.col(b_xy[1]))
    return (
        rows.join(probe, ["_cx", "_cy", "_part"])
        .withColumn("dist", gap)
        .filter(F.col("dist") <= r)
        .drop("_cx", "_cy", "_part")
    )


def has_within(a: DataFrame, b: DataFrame, r: float, key: str, a_xy=("sx", "sy"), b_xy=("x", "y")) -> DataFrame:
    """Distinct keys of `a` with at least one `b` within r; coincident b points count once."""
    spots = b.select(F.col(b_xy[0]).alias("_bx"), F.col(b_xy[1]).alias("_by")).distinct()
    return within_distance(a.select(key, *a_xy), spots, r, a_xy, ("_bx", "_by")).select(key).distinct()


def radius_name(r: float) -> str:
    """800 of 800.0, 0_5 of 0.5: what the columns of a radius end with."""
    return f"{r:g}".replace(".", "_")


def catchment_totals(
    origins: DataFrame,
    key: str,
    points: DataFrame,
    radii: Sequence[float],
    measures: dict[str, Column],
    o_xy: tuple[str, str] = ("sx", "sy"),
    p_xy: tuple[str, str] = ("x", "y"),
    split: int = 6,
    wanted: Sequence[tuple[str, float]] | None = None,
) -> DataFrame:
    """Sums of additive measures within several radii of each origin; of all radii each, or as `wanted` (measure, radius) says.

    Cells wholly inside (or outside) every ring use per-cell sums made before
    the join; only cells cut by a circle are joined point by point, and those
    points are first summed per distinct location.
    """
    wanted = list(wanted or [(n, r) for r in radii for n in measures])
    found = _ring_sums(origins, key, points, radii, measures, wanted, (), o_xy, p_xy, split)
    names = [f"{n}_{radius_name(r)}" for n, r in wanted]
    return origins.join(found, key, "left").select(*origins.columns, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def _ring_sums(
    origins: DataFrame, key: str, points: DataFrame, radii: Sequence[float], measures: dict[str, Column], wanted: Sequence[tuple[str, float]],
    by: Sequence[str], o_xy: tuple[str, str], p_xy: tuple[str, str], split: int,
) -> DataFrame:
    """key, by and the wanted sums (`<measure>_<radius>`, null for none) of the points' groups `by` that each origin meets.

    Cells with their sums and the points of cells are the two kinds of rows that one join meets, so the cells round an
    origin are listed once.
    """
    cell = max(radii) / split
    spots = points.groupBy(F.col(p_xy[0]).alias("_px"), F.col(p_xy[1]).alias("_py"), *by).agg(*[F.sum(c).alias(n) for n, c in measures.items()])
    spots = spots.withColumn("_cx", cell_of(F.col("_px"), cell)).withColumn("_cy", cell_of(F.col("_py"), cell))
    cells = spots.groupBy("_cx", "_cy", *by).agg(*[F.sum(n).alias(n) for n in measures])
    none = F.lit(None).cast("double")
    rows = spots.withColumn("_cut", F.lit(True)).unionByName(cells.withColumns({"_px": none, "_py": none, "_cut": F.lit(False)}))
    probe = _cells_round(spread(origins.select(key, F.col(o_xy[0]).alias("_ox"), F.col(o_xy[1]).alias("_oy"))), key, radii, cell, split)
    rows, probe = split_full(rows, probe, ["_cx", "_cy", "_cut"], ["_px", "_py", *by], count_pairs=False)
    met = probe.join(rows, ["_cx", "_cy", "_cut", "_part"])
    met = met.withColumn("_reach", F.when(F.col("_cut"), F.hypot(F.col("_px") - F.col("_ox"), F.col("_py") - F.col("_oy"))).otherwise(F.col("_far")))
    return met.filter(F.col("_reach") <= max(radii)).groupBy(key, *by).agg(
        *[F.sum(F.when(F.col("_reach") <= r, F.col(n))).alias(f"{n}_{radius_name(r)}") for n, r in wanted]
    )


def catchment_sums_by(
    origins: DataFrame, key: str, points: DataFrame, measures: dict[str, Column], wanted: Sequence[tuple[str, float]], by: Sequence[str],
    o_xy: tuple[str, str] = ("sx", "sy"), p_xy: tuple[str, str] = ("x", "y"), split: int = 12,
) -> DataFrame:
    """key, by, `<measure>_<radius>` as `wanted` says (null for none): sums per group of the points, for groups that the widest circle meets."""
    return _ring_sums(origins, key, points, sorted({r for _, r in wanted}), measures, wanted, by, o_xy, p_xy, split)


def largest_within(
    origins: DataFrame, key: str, points: DataFrame, p_key: str, value: str, r: float, k: int,
    o_xy: tuple[str, str] = ("sx", "sy"), p_xy: tuple[str, str] = ("x", "y"), rank: str = "rk",
) -> DataFrame:
    """key, p_key, value, rank: the k points of greatest value (ties: lowest p_key) no more than r from each origin.

    A cell with a diagonal of r lies in the circle of every origin in it, so the cell's kth value is a bound: pairs below
    it are dropped where they are met, and few are ordered.
    """
    cell = r / math.sqrt(2) * (1 - 1e-9)
    rows = points.select(p_key, value, F.col(p_xy[0]).alias("_px"), F.col(p_xy[1]).alias("_py"))
    order = [F.col(value).desc(), F.col(p_key)]
    homes = rows.select(p_key, value, cell_of(F.col("_px"), cell).alias("_hx"), cell_of(F.col("_py"), cell).alias("_hy"))
    bound = first_per(homes, ["_hx", "_hy"], order, k, "_kth").filter(F.col("_kth") == k).select("_hx", "_hy", F.col(value).alias("_least"))
    asked = origins.select(key, F.col(o_xy[0]).alias("_ox"), F.col(o_xy[1]).alias("_oy"))
    asked = asked.withColumns({"_hx": cell_of(F.col("_ox"), cell), "_hy": cell_of(F.col("_oy"), cell)}).join(bound, ["_hx", "_hy"], "left").drop("_hx", "_hy")
    met = within_distance(asked, rows, r, ("_ox", "_oy"), ("_px", "_py")).filter(F.col("_least").isNull() | (F.col(value) >= F.col("_least")))
    return first_per(met.select(key, p_key, value), [key], order, k, rank)


def lowest_within(
    a: DataFrame, a_key: str, b: DataFrame, b_key: str, by: str, r: float, a_xy: tuple[str, str] = ("x", "y"), b_xy: tuple[str, str] = ("x", "y")
) -> DataFrame:
    """a_key, b_key: of the b with the same `by` no more than r away the one of the lowest key; rows of a with none are left out.

    A cell with a diagonal of r lies in the circle of every row of a in it, so the cell's lowest key is a bound: what is
    not below it is dropped where it is met. A row of a meets all it can want in one task.
    """
    cell = r / math.sqrt(2) * (1 - 1e-9)
    x, y, bx, by_ = F.col("_ax"), F.col("_ay"), F.col("_bx"), F.col("_by")
    rows = b.groupBy(by, F.col(b_xy[0]).alias("_bx"), F.col(b_xy[1]).alias("_by")).agg(F.min(b_key).alias(b_key))
    spots = cut_lineage(rows.filter(bx.isNotNull() & by_.isNotNull()))
    bound = spots.groupBy(by, cell_of(bx, cell).alias("_hx"), cell_of(by_, cell).alias("_hy")).agg(F.min(b_key).alias("_least"))
    asking = a.select(a_key, by, F.col(a_xy[0]).alias("_ax"), F.col(a_xy[1]).alias("_ay")).withColumns({"_hx": cell_of(x, cell), "_hy": cell_of(y, cell)})
    asking = cut_lineage(asking.join(bound, [by, "_hx", "_hy"], "left").drop("_hx", "_hy"))
    at = [by, "_cx", "_cy"]
    listed = spread(spots).withColumn("_c", F.explode(_around(bx, by_, r))).select(*spots.columns, F.col("_c.cx").alias("_cx"), F.col("_c.cy").alias("_cy"))
    asked, listed = split_full(asking.withColumns({"_cx": cell_of(x, r), "_cy": cell_of(y, r)}), listed, at, [a_key, "_ax", "_ay"])
    met = asked.join(listed, [*at, "_part"]).filter((F.col("_least").isNull() | (F.col(b_key) < F.col("_least"))) & (F.hypot(x - bx, y - by_) <= r))
    settled = asking.filter(F.col("_least").isNotNull()).select(a_key, F.col("_least").alias(b_key))
    return met.select(a_key, b_key).unionByName(settled).groupBy(a_key).agg(F.min(b_key).alias(b_key))


def catchment_quantiles(
    origins: DataFrame, key: str, points: DataFrame, r: float, values: dict[str, Column], probs: dict[str, float],
    o_xy: tuple[str, str] = ("sx", "sy"), p_xy: tuple[str, str] = ("x", "y"), split: int = 6,
) -> DataFrame:
    """key, `<value>_n`, `<value>_<prob name>`: exact continuous quantiles of the values no more than r away, for origins that have any.

    Pairs are not made into rows: values are cut into BUCKETS by borders that are the same everywhere, points are counted
    per origin and bucket by `catchment_totals`' cells, and only points of the buckets that hold a wanted rank meet their
    origins one by one. The borders are approximate quantiles; they tell how even the buckets are, not the result.
    """
    names = list(values)
    kinds = F.array(*[F.struct(F.lit(i).alias("_value"), c.cast("double").alias("_v")) for i, c in enumerate(values.values())])
    long = points.select(F.col(p_xy[0]).alias("_x"), F.col(p_xy[1]).alias("_y"), F.explode(kinds).alias("_s")).select("_x", "_y", "_s.*").filter(F.col("_v").isNotNull())
    cuts = [i / BUCKETS for i in range(1, BUCKETS)]
    borders = {x._value: sorted(set(x.b)) for x in long.groupBy("_value").agg(F.percentile_approx("_v", cuts, 1000).alias("b")).collect()}  # a row per value

    def bucket(own: list[float], low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("_v") <= own[mid], bucket(own, low, mid)).otherwise(bucket(own, mid + 1, high))

    place = F.lit(0)
    for i, own in borders.items():
        place = F.when(F.col("_value") == i, bucket(own, 0, len(own))).otherwise(place)
    long = long.withColumn("_b", place)
    k = f"_k_{radius_name(r)}"
    counts = _ring_sums(origins, key, long, [r], {"_k": F.lit(1)}, [("_k", r)], ("_value", "_b"), o_xy, ("_x", "_y"), split)
    # a row per origin and bucket, so these windows hold BUCKETS rows
    group = Window.partitionBy(key, "_value")
    before = F.sum(k).over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col(k)
    placed = counts.withColumns({"_before": before, "_n": F.sum(k).over(group)})
    at = {p: F.lit(q) * (F.col("_n") - 1) for p, q in probs.items()}

    def holds(rank: Column, first: Column, n: Column) -> Column:
        return (rank >= first) & (rank < first + n)

    hit = F.lit(False)
    for a in at.values():
        hit = hit | holds(F.floor(a), F.col("_before"), F.col(k)) | holds(F.ceil(a), F.col("_before"), F.col(k))
    asked = cut_lineage(placed.filter(hit).select(key, "_value", "_b", "_before", "_n"))
    probe = asked.join(origins.select(key, F.col(o_xy[0]).alias("_ox"), F.col(o_xy[1]).alias("_oy")), key)
    probe = probe.withColumn("_c", F.explode(_around(F.col("_ox"), F.col("_oy"), r))).select(*probe.columns, F.col("_c.cx").alias("_cx"), F.col("_c.cy").alias("_cy"))
    rows = long.withColumns({"_cx": cell_of(F.col("_x"), r), "_cy": cell_of(F.col("_y"), r)})
    on = ["_value", "_b", "_cx", "_cy"]
    rows, probe = split_full(rows, probe, on, ["_x", "_y", "_v"])
    met = rows.join(probe, [*on, "_part"]).filter(F.hypot(F.col("_ox") - F.col("_x"), F.col("_oy") - F.col("_y")) <= r)
    met = met.groupBy(key, "_value", "_b", "_before", "_n", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(key, "_value", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    met = met.withColumn("_first", F.col("_before") + upto - F.col("_c"))
    aggs = []
    for i, name in enumerate(names):
        mine = F.col("_value") == i
        aggs.append(F.coalesce(F.max(F.when(mine, F.col("_n"))), F.lit(0)).alias(f"{name}_n"))
        for p, a in at.items():
            low, high = (F.max(F.when(mine & holds(rank, F.col("_first"), F.col("_c")), F.col("_v"))) for rank in (F.floor(a), F.ceil(a)))
            aggs.append((low + (high - low) * F.max(F.when(mine, a - F.floor(a)))).alias(f"{name}_{p}"))
    return met.groupBy(key).agg(*aggs)


def _cells_round(origins: DataFrame, key: str, radii: Sequence[float], cell: float, split: int) -> DataFrame:
    """key, _ox, _oy, _cx, _cy, _cut, _far: the cells that the widest circle meets, `_cut` if any circle cuts them.

    Squares of distances settle it, with a margin beyond rounding: a cell within the margin counts as cut, so its points
    are tested. `_far` of a cell that is not cut is no more than a radius just where the cell is inside.
    """
    span = F.array(*[F.lit(i) for i in range(-split - 1, split + 2)])

    def gaps(o: str, c: str) -> tuple[Column, Column]:
        lo, hi = F.col(o) - F.col(c) * cell, (F.col(c) + 1) * cell - F.col(o)
        near = F.greatest(-lo, -hi, F.lit(0.0))
        far = F.greatest(lo, hi)  # one of both is the farther side wherever the origin is
        return near * near, far * far

    nx, fx = gaps("_ox", "_cx")
    ny, fy = gaps("_oy", "_cy")
    around = origins.withColumn("_home", cell_of(F.col("_oy"), cell)).withColumn("_i", F.explode(span))
    around = around.select(key, "_ox", "_oy", "_home", (cell_of(F.col("_ox"), cell) + F.col("_i")).alias("_cx"))
    around = around.select("*", nx.alias("_nx"), fx.alias("_fx")).withColumn("_i", F.explode(span))
    around = around.select(key, "_ox", "_oy", "_cx", "_nx", "_fx", (F.col("_home") + F.col("_i")).alias("_cy"))
    # through an array of one the gaps are worked out once, not once per radius
    gap = F.struct((F.col("_nx") + ny).alias("near"), (F.col("_fx") + fy).alias("far"))
    around = around.withColumn("_g", F.explode(F.array(gap))).filter(F.col("_g.near") <= max(radii) ** 2 * (1 + MARGIN))
    cut = F.lit(False)
    for r in radii:
        cut = cut | ((F.col("_g.near") <= r * r * (1 + MARGIN)) & (F.col("_g.far") > r * r * (1 - MARGIN)))
    return around.select(key, "_ox", "_oy", "_cx", "_cy", cut.alias("_cut"), F.sqrt("_g.far").alias("_far"))


def _levels(sites: DataFrame, max_m: float, k: int, layer: str | None = None) -> int:
    """How many levels it takes until no cell holds more than a part of k sites, so a block of 3 x 3 holds about k (3 to MOST_LEVELS)."""
    finest = max_m / 2 ** (MOST_LEVELS - 1)
    other = [c for c in sites.columns if c == layer]
    cells = sites.groupBy(*other, F.floor(F.col("_bx") / finest).alias("x"), F.floor(F.col("_by") / finest).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    halved = F.array(*[F.lit(i) for i in range(MOST_LEVELS)])
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2), F.col("l")))
    coarse = cells.withColumn("l", F.explode(halved)).groupBy(*other, "l", up("x").alias("x"), up("y").alias("y")).agg(F.sum("n").alias("n"))
    fullest = {r.l: r.n for r in coarse.groupBy("l").agg(F.max("n").alias("n")).collect()}  # MOST_LEVELS rows
    fit = [l for l in range(MOST_LEVELS) if fullest.get(l, 0) <= 2 + k // 4]
    return max(3, MOST_LEVELS - max(fit, default=0))


def nearest(
    a: DataFrame,
    a_key: str,
    b: DataFrame,
    b_key: str,
    max_m: float,
    k: int = 1,
    a_xy: tuple[str, str] = ("sx", "sy"),
    b_xy: tuple[str, str] = ("x", "y"),
    levels: int | None = None,
    cols: Sequence[str] = (),
    layer: str | None = None,
    layers: Sequence[str] = (),
) -> DataFrame:
    """a_key, b_key, dist, nn_rank for the k nearest b no more than max_m away.

    With `layer`, a column of b, the k nearest of each of `layers` in one pass; without `layers` it is a column of a as
    well, and the k nearest with a's own value are found.

    Cells double in size per level. Counting b per cell and level tells, for
    each occupied a-cell, the first level whose 3 x 3 block holds k points; the
    block's farthest corner bounds the search, so sparse areas look far and dense
    areas look close. Two levels up no circle of that size leaves the 3 x 3 block,
    so b is listed for each of its nine cells there and a row of a meets all it
    can want in one task, which keeps k of them: pairs are not shuffled. Only the
    k lowest keys of coincident b points are kept. Levels go down (if `levels`
    does not say how far) until the fullest cell holds few points.
    """
    bx, by = F.col("_bx"), F.col("_by")
    per = [layer] if layer else []
    sites = b.select(F.col(b_key), F.col(b_xy[0]).alias("_bx"), F.col(b_xy[1]).alias("_by"), *per, *cols)
    # what lies nowhere is near nothing, and must not be counted either
    sites = sites.filter((F.abs(bx) < float("inf")) & (F.abs(by) < float("inf")))
    sites = cut_lineage(first_per(sites, [*per, "_bx", "_by"], [F.col(b_key)], k))
    levels = levels or _levels(sites, max_m, k, layer)
    base = max_m / 2 ** (levels - 1)
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2), F.col("_l"))).cast("int")
    counted = (
        sites.groupBy(*per, F.floor(bx / base).alias("_fx"), F.floor(by / base).alias("_fy"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_l", F.explode(F.array(*[F.lit(i) for i in range(levels)])))
        .groupBy(*per, "_l", up("_fx").alias("_gx"), up("_fy").alias("_gy"))
        .agg(F.sum("_n").alias("_n"))
    )
    ax, ay = F.col(a_xy[0]), F.col(a_xy[1])
    own = per if not layers else []
    seeds = spread(a.select(a_key, *own, ax.alias("_ax"), ay.alias("_ay"))).withColumn("_hx", F.floor(F.col("_ax") / base)).withColumn("_hy", F.floor(F.col("_ay") / base))
    if layers:
        seeds = seeds.withColumn(layer, F.explode(F.array(*map(F.lit, layers))))
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    moved = [(F.col(c) + F.col(f"_s.{i}")).alias(c) for c, i in (("_gx", "i"), ("_gy", "j"))]
    blocks = counted.withColumn("_s", F.explode(shifts)).groupBy(*per, "_l", *moved).agg(F.sum("_n").alias("_n")).filter(F.col("_n") >= k).drop("_n")
    homes = (
        seeds.select(*per, "_hx", "_hy").distinct()
        .withColumn("_l", F.explode(F.array(*[F.lit(i) for i in range(levels)])))
        .withColumns({"_gx": up("_hx"), "_gy": up("_hy")})
        .join(blocks, [*per, "_l", "_gx", "_gy"])
        .groupBy(*per, "_hx", "_hy").agg(F.min("_l").alias("_first"))
    )
    first = F.coalesce("_first", F.lit(levels))
    size = F.lit(base) * F.pow(F.lit(2), first)

    def farther(v: str, home: str) -> Column:
        """How far the farther side of the block is."""
        at = F.floor(F.col(home) / F.pow(F.lit(2), first))
        return F.greatest(F.col(v) - (at - 1) * size, (at + 2) * size - F.col(v))

    bound = F.least(F.lit(float(max_m)), F.hypot(farther("_ax", "_hx"), farther("_ay", "_hy")) * (1 + 1e-6))
    asking = seeds.join(homes, [*per, "_hx", "_hy"], "left").withColumn("_r", F.when(first < levels, bound).otherwise(F.lit(float(max_m))))
    asking = asking.withColumn("_l", F.least(first + 2, F.lit(levels - 1))).withColumns({"_gx": up("_hx"), "_gy": up("_hy")})
    asking = cut_lineage(asking.select(a_key, *per, "_ax", "_ay", "_r", "_l", "_gx", "_gy"))
    at = [*per, "_l", "_gx", "_gy"]
    asked = cut_lineage(asking.select(*at).distinct())
    used = [r._l for r in asked.select("_l").distinct().collect()]  # MOST_LEVELS rows at most
    listed = (
        spread(sites).withColumns({"_fx": F.floor(bx / base), "_fy": F.floor(by / base)})
        .withColumn("_l", F.explode(F.array(*[F.lit(i) for i in used]).cast("array<int>")))
        .withColumns({"_gx": up("_fx"), "_gy": up("_fy")})
    )
    if asked.count() < sites.count():
        # sites that nobody looks for go before they are listed
        listed = listed.join(asked.withColumn("_s", F.explode(shifts)).select(*per, "_l", *moved).distinct(), at, "left_semi")
    listed = listed.withColumn("_s", F.explode(shifts)).select(*sites.columns, "_l", *moved)
    asking, listed = split_full(asking, listed, at, [a_key])
    pairs = (
        asking.join(listed, [*at, "_part"])
        .withColumn("dist", F.hypot(F.col("_ax") - bx, F.col("_ay") - by))
        .filter(F.col("dist") <= F.col("_r"))
        .select(a_key, *per, b_key, "dist", *cols)
    )
    return first_per(pairs, [a_key, *per], [F.col("dist"), F.col(b_key)], k, "nn_rank")


def distance_units(dist: Column, cap: int = 255) -> Column:
    """100 m units with 255 for nothing in range."""
    return F.least(F.coalesce(F.round(dist / 100), F.lit(cap)), F.lit(cap)).cast("int")


def best_of_nearest(
    a: DataFrame, a_key: str, b: DataFrame, b_key: str, cost: str, max_m: float, k: int = 8, per_m: float = 1.25 / 80, **xy
) -> DataFrame:
    """Among the k nearest, the one with the least node cost plus walking time."""
    near = nearest(a, a_key, b, b_key, max_m, k, cols=[cost], **xy)
    total = near.withColumn("minutes", F.col(cost) + F.col("dist") * per_m)
    return first_per(total, [a_key], [F.col("minutes"), F.col(b_key)]).select(a_key, b_key, "dist", "minutes")


def adaptive_radius(
    a: DataFrame, a_key: str, obs: DataFrame, radii: Sequence[float], min_n: int, **xy
) -> DataFrame:
    """a_key, radius, n: the first radius with at least min_n observations (else the last)."""
    counts = catchment_totals(a, a_key, obs, radii, {"n": F.lit(1)}, **xy)
    radius, n = F, F
    for r in radii:
        count = F.col(f"n_{radius_name(r)}")
        radius, n = radius.when(count >= min_n, F.lit(float(r))), n.when(count >= min_n, count)
    last = radii[-1]
    return counts.select(
        *a.columns, radius.otherwise(F.lit(float(last))).alias("radius"), n.otherwise(F.col(f"n_{radius_name(last)}")).alias("n")
    )


# ---- polygons --------------------------------------------------------------


def points_in_polygons(
    points: DataFrame, p_key: str, polys: DataFrame, g_key: str, cell: float, p_xy: tuple[str, str] = ("x", "y"),
    rings: str = "rings", covered: DataFrame | None = None, cols: Sequence[str] = (), p_cols: Sequence[str] = (),
) -> DataFrame:
    """(p_key, g_key) pairs with the point inside; half-open on the upper and right edges.

    Points in full cells are inside at once; for the rest a ray is cast upward
    against the polygon's edges of that grid column only. Those edges travel
    with the cell (and so do the columns `cols` of the polygon), so a candidate
    is settled where it is met and only pairs that hold leave the task; all of
    a point's pairs are made in one task. Columns with more than MOST_EDGES
    edges of one polygon are joined instead.
    """
    edges = edge_columns(ring_edges(polys, [g_key, *cols], rings), cell).select(g_key, *cols, "cx", "x1", "y1", "x2", "y2")
    edges = edges.withColumn("_many", F.count(F.lit(1)).over(Window.partitionBy(g_key, "cx")) > MOST_EDGES)
    edge = F.when(~F.col("_many"), F.struct("x1", "y1", "x2", "y2"))
    lists = edges.groupBy(g_key, "cx").agg(*[F.first(c).alias(c) for c in cols], F.max("_many").alias("_many"), F.collect_list(edge).alias("_edges"))
    tiles = covered if covered is not None else cover(polys, [g_key], cell, rings)
    # edges wholly below a cell can't meet a ray that begins in it
    above = F.filter("_edges", lambda e: F.greatest(e.y1, e.y2) > F.col("cy") * cell)
    tiles = tiles.select(g_key, "cx", "cy", "full").join(lists, [g_key, "cx"])
    tiles = cut_lineage(tiles.select(g_key, *cols, "cx", "cy", "full", (F.col("_many") & ~F.col("full")).alias("_many"), F.when(~F.col("full"), above).alias("_edges")))
    pts = points.select(
        p_key, *p_cols, F.col(p_xy[0]).alias("_x"), F.col(p_xy[1]).alias("_y"),
        cell_of(F.col(p_xy[0]), cell).alias("cx"), cell_of(F.col(p_xy[1]), cell).alias("cy"),
    )
    dots, asked = split_full(pts, tiles, ["cx", "cy"], [p_key])
    cand = dots.join(asked, ["cx", "cy", "_part"])
    pair = [p_key, g_key, *p_cols, *cols]

    def crossed(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        at_x = y1 + (y2 - y1) * (F.col("_x") - x1) / (x2 - x1)
        return (x1 <= F.col("_x")) & (F.col("_x") < x2) & (at_x > F.col("_y"))

    hits = F.size(F.filter("_edges", lambda e: crossed(e.x1, e.y1, e.x2, e.y2)))
    sure = cand.filter(F.col("full") | (~F.col("_many") & (hits % 2 == 1))).select(*pair)
    if tiles.filter("_many").isEmpty():
        return sure
    many = edges.filter("_many").select(g_key, "cx", "x1", "y1", "x2", "y2")
    tested = (
        cand.filter("_many")
        .join(many, [g_key, "cx"])
        .filter(crossed(*map(F.col, ("x1", "y1", "x2", "y2"))))
        .groupBy(*pair)
        .agg(F.count(F.lit(1)).alias("_hits"))
        .filter(F.col("_hits") % 2 == 1)
        .select(*pair)
    )
    return sure.unionByName(tested)


def polygons_intersect(a: DataFrame, a_key: str, b: DataFrame, b_key: str, cell: float) -> DataFrame:
    """Distinct pairs that share area (fragments of both, see overlay.fragments)."""
    return overlap_areas(a, [a_key], b, [b_key], cell).select(a_key, b_key)


def containing_area(
    inside: DataFrame, p_key: str, areas: DataFrame, g_key: str, keys: Sequence[str], size: str, largest: bool = False
) -> DataFrame:
    """The smallest (or largest) containing polygon per point and dataset.

    Keys and size are looked up in `areas` if the pairs don't bring them (`cols` of points_in_polygons).
    """
    order = F.col(size).desc() if largest else F.col(size).asc()
    missing = [c for c in (*keys, size) if c not in inside.columns]
    joined = inside.join(areas.select(g_key, *missing), g_key) if missing else inside
    return first_per(joined, [p_key, *keys], [order, F.col(g_key)])


def covers_site(
    sites: DataFrame, site_key: str, covering: DataFrame, area_key: str, cell: float,
    inside: DataFrame, share: float = 0.1,
) -> DataFrame:
    """Pairs where the site's point is inside or at least `share` of its area is covered (fragments of both)."""
    part = (
        overlap_areas(sites, [site_key], covering, [area_key], cell)
        .join(areas(sites, [site_key]).withColumnRenamed("area", "_size"), site_key)
        .filter(F.col("area") >= share * F.col("_size"))
        .select(site_key, area_key)
    )
    return part.unionByName(inside.select(site_key, area_key)).distinct()


def area_weighted(
    target: DataFrame, t_key: str, source: DataFrame, s_key: str, cell: float, facts: DataFrame,
    amount: str, means: Sequence[str],
) -> DataFrame:
    """Areal transfer between fragments: sum of amount x share, and amount-weighted means with per-mean null denominators."""
    size = areas(source, [s_key]).withColumnRenamed("area", "_size")
    w = F.col(amount) * F.col("area") / F.col("_size")
    shared = overlap_areas(target, [t_key], source, [s_key], cell).join(size, s_key).join(facts, s_key)
    return shared.groupBy(t_key).agg(
        F.sum(w).alias(amount),
        *[
            (F.sum(w * F.col(m)) / F.nullif(F.sum(F.when(F.col(m).isNotNull(), w)), F.lit(0.0))).alias(m)
            for m in means
        ],
    )


def supplement(candidates: DataFrame, key: str, existing: DataFrame, cell: float, most: float = 0.5) -> DataFrame:
    """Keys of the candidates of which existing polygons, overlaps counted once, cover less than `most` (fragments of both, one polygon per candidate)."""
    shared = covered_by(candidates, [key], existing, [], cell, apart=True)
    size = areas(candidates, [key]).withColumnRenamed("area", "_size")
    return size.join(shared, key, "left").filter(F.coalesce("area", F.lit(0.0)) < most * F.col("_size")).select(key)
