"""Polygons on a square grid: the cells of each with the exact area inside, discs of cells, growth by cells.

Areas of two and more polygons in one cell are the matter of `overlay`, regions of whole cells that of `regions`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgauge.functions.geometry import edges_of, signed_ring_area
from landgauge.session import spread

EPS = 1e-9


def cell_of(v: Column, cell: float) -> Column:
    return F.floor(v / F.lit(float(cell))).cast("int")


def ring_edges(df: DataFrame, keys: Sequence[str], rings: str = "rings") -> DataFrame:
    """One row per edge, left to right, with `turn` +1 where the inside lies below it."""
    exploded = spread(df.select(*keys, rings)).select(*keys, F.posexplode(rings).alias("_ring_no", "_ring"))
    outward = F.when(F.col("_ring_no") == 0, 1.0).otherwise(-1.0) * F.signum(signed_ring_area(F.col("_ring")))
    e = F.col("_e")
    # worked out before the explode: beside it, each edge would sum up its whole ring again
    turned = exploded.select(*keys, outward.alias("_w"), edges_of(F.col("_ring")).alias("_edges"))
    rows = turned.select(*keys, "_w", F.explode("_edges").alias("_e"))
    forward = e.a.x <= e.b.x
    return rows.select(
        *keys,
        F.when(forward, e.a.x).otherwise(e.b.x).alias("x1"),
        F.when(forward, e.a.y).otherwise(e.b.y).alias("y1"),
        F.when(forward, e.b.x).otherwise(e.a.x).alias("x2"),
        F.when(forward, e.b.y).otherwise(e.a.y).alias("y2"),
        (F.col("_w") * F.when(forward, -1.0).otherwise(1.0)).alias("turn"),
    ).filter(F.col("x1") < F.col("x2"))


def edge_columns(edges: DataFrame, cell: float) -> DataFrame:
    """Edges repeated for each grid column (`cx`) they cross."""
    first, last = cell_of(F.col("x1"), cell), F.ceil(F.col("x2") / cell).cast("int") - 1
    return edges.withColumn("cx", F.explode(F.sequence(first, F.greatest(first, last))))


def _height_integral(u: Column, h: float) -> Column:
    """Antiderivative of clamp(u, 0, h)."""
    return F.when(u <= 0, 0.0).when(u <= h, u * u / 2).otherwise(h * h / 2 + h * (u - h))


def cover(df: DataFrame, keys: Sequence[str], cell: float, rings: str = "rings") -> DataFrame:
    """keys, cx, cy, area (m2 of the polygon in the cell), full.

    Each edge adds, with its sign, the area under it inside the cells of its
    grid column; cells lower down get the whole strip. The strip is carried by
    a window over one polygon's grid column, so nothing holds a whole polygon.
    """
    keys = list(keys)
    cols = edge_columns(ring_edges(df, keys, rings), cell)
    slope = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    xl = F.greatest(F.col("x1"), F.col("cx") * cell)
    xr = F.least(F.col("x2"), (F.col("cx") + 1) * cell)
    seg = cols.select(
        *keys, "cx", "turn", (xr - xl).alias("w"),
        (F.col("y1") + slope * (xl - F.col("x1"))).alias("yl"),
        (F.col("y1") + slope * (xr - F.col("x1"))).alias("yr"),
    )
    low, high = F.least("yl", "yr"), F.greatest("yl", "yr")
    first = cell_of(low, cell)
    last = F.greatest(first, F.ceil(high / cell).cast("int") - 1)
    pieces = seg.withColumn("_first", first).withColumn("cy", F.explode(F.sequence(first, last)))
    ul, ur = F.col("yl") - F.col("cy") * cell, F.col("yr") - F.col("cy") * cell
    sloped = F.col("w") * (_height_integral(ur, cell) - _height_integral(ul, cell)) / (ur - ul)
    level = F.col("w") * F.least(F.greatest(ul, F.lit(0.0)), F.lit(float(cell)))
    inside = F.when(F.abs(ur - ul) > 1e-12, sloped).otherwise(level)
    strip = F.when(F.col("cy") == F.col("_first"), F.col("turn") * F.col("w") * cell).otherwise(0.0)
    per_cell = pieces.groupBy(*keys, "cx", "cy").agg(
        F.sum(F.col("turn") * inside).alias("_in"), F.sum(strip).alias("_strip")
    )
    down = Window.partitionBy(*keys, "cx").orderBy(F.col("cy").desc())
    carried = F.sum("_strip").over(down.rowsBetween(Window.unboundedPreceding, 0))
    rows = per_cell.select(
        *keys, "cx", "cy",
        (F.col("_in") + carried - F.col("_strip")).alias("_own"),
        carried.alias("_below"),
        F.lead("cy").over(down).alias("_next"),
    )
    gap = F.when(
        (F.col("_below") > EPS * cell * cell) & (F.col("cy") - F.col("_next") > 1),
        F.sequence(F.col("_next") + 1, F.col("cy") - 1),
    ).otherwise(F.array().cast("array<int>"))
    cells = F.concat(
        F.array(F.struct(F.col("cy").alias("cy"), F.col("_own").alias("area"))),
        F.transform(gap, lambda c: F.struct(c.alias("cy"), F.col("_below").alias("area"))),
    )
    size = float(cell) * cell
    return (
        rows.select(*keys, "cx", F.explode(cells).alias("_c"))
        .select(*keys, "cx", "_c.cy", F.least(F.col("_c.area"), F.lit(size)).alias("area"))
        .filter(F.col("area") > EPS * size)
        .withColumn("full", F.col("area") >= size * (1 - EPS))
    )


def disc_cells(points: DataFrame, keys: Sequence[str], x: Column, y: Column, r: Column | float, cell: float) -> DataFrame:
    """keys, cx, cy for cells whose centre lies within r of the point."""
    r = r if isinstance(r, Column) else F.lit(float(r))
    base = spread(points.select(*keys, x.alias("_x"), y.alias("_y"), r.alias("_r")))
    cxs = F.sequence(cell_of(F.col("_x") - F.col("_r"), cell), cell_of(F.col("_x") + F.col("_r"), cell))
    base = base.withColumn("cx", F.explode(cxs))
    cys = F.sequence(cell_of(F.col("_y") - F.col("_r"), cell), cell_of(F.col("_y") + F.col("_r"), cell))
    near = F.hypot((F.col("cx") + 0.5) * cell - F.col("_x"), (F.col("cy") + 0.5) * cell - F.col("_y")) <= F.col("_r")
    return base.withColumn("cy", F.explode(cys)).filter(near).select(*keys, "cx", "cy")


def dilate(cells: DataFrame, keys: Sequence[str], k: int, within: DataFrame | None = None, within_keys: Sequence[str] = ()) -> DataFrame:
    """Cells grown by k cells (disc neighbourhood), optionally clipped to `within`."""
    offsets = [(dx, dy) for dx in range(-k, k + 1) for dy in range(-k, k + 1) if dx * dx + dy * dy <= k * k]
    shifts = F.array(*[F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy")) for dx, dy in offsets])
    if within is not None:
        # clip first: only cells near the catchment can grow into it
        coarse = within.select(*within_keys, *[F.floor(F.col(c) / (2 * k + 1)).alias(f"_{c}") for c in ("cx", "cy")]).distinct()
        around = F.array(*[F.struct((F.col("_cx") + dx).alias("_cx"), (F.col("_cy") + dy).alias("_cy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
        near = coarse.select(*within_keys, F.explode(around).alias("_s")).select(*within_keys, "_s._cx", "_s._cy").distinct()
        cells = (
            cells.withColumn("_cx", F.floor(F.col("cx") / (2 * k + 1)))
            .withColumn("_cy", F.floor(F.col("cy") / (2 * k + 1)))
            .join(near, [*within_keys, "_cx", "_cy"], "left_semi")
            .drop("_cx", "_cy")
        )
    grown = cells.select(*keys, F.explode(shifts).alias("_s")).select(*keys, "_s.cx", "_s.cy").distinct()
    if within is not None:
        grown = grown.join(within.select(*within_keys, "cx", "cy").distinct(), [*within_keys, "cx", "cy"], "left_semi")
    return grown
