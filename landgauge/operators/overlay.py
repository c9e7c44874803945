"""Exact polygon overlay on a square grid, for shapes that lie anywhere.

`fragments` cuts every polygon into the grid. A cell that an outline crosses
holds signed pieces: for any x, the polygon is what lies below pieces of sign +1
less what lies below those of sign -1. Pieces are the edges inside the cell and
level lids on its upper border, one for each place where the outline crosses that
border (a polygon's lid is worked out from running sums down its grid column,
never from all edges above). Whole cells are ranges of one grid column.

Two polygons share, in a cell, the signed sum over pairs of pieces of the area
below both; only cells that outlines of both cross need pairs. Unions,
differences and anything else of several polygons come from `layers_in_cells`:
between neighbouring ends and crossings of the pieces their order does not
change, so running sums from the top tell which layers cover each strip.

Everything is joins, grouped sums and windows over one cell's pieces. What several
joins read is written to the shared folder once. Areas are in square units of the
coordinates; what is below EPS of a cell counts as nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgauge.operators.cells import EPS, cell_of, edge_columns, ring_edges
from landgauge.operators.splits import split_full
from landgauge.session import cut_lineage, shuffle_width

PIECE = ["xa", "ya", "xb", "yb", "sign"]
BLOCK = 64  # cells of a grid column that share a join key


def fragments(df: DataFrame, keys: Sequence[str], cell: float, rings: str = "rings") -> DataFrame:
    """keys, cx, lo, hi, full, xa, ya, xb, yb, sign (piece coordinates from the cell's lower left corner).

    Rows with `full` are whole cells lo..hi of column cx; the others are pieces of the cell lo = hi. Rings as in `cover`.
    """
    keys, cell = list(keys), float(cell)
    cols = edge_columns(ring_edges(df, keys, rings), cell)
    slope = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    xl, xr = F.greatest(F.col("x1"), F.col("cx") * cell), F.least(F.col("x2"), (F.col("cx") + 1) * cell)
    seg = cols.select(
        *keys, "cx", F.col("turn").alias("sign"), xl.alias("xl"), xr.alias("xr"),
        (F.col("y1") + slope * (xl - F.col("x1"))).alias("yl"), (F.col("y1") + slope * (xr - F.col("x1"))).alias("yr"),
    )
    first = cell_of(F.least("yl", "yr"), cell)
    last = F.greatest(first, F.ceil(F.greatest("yl", "yr") / cell).cast("int") - 1)
    rows = seg.withColumn("_first", first).withColumn("_last", last).withColumn("cy", F.explode(F.sequence("_first", "_last")))
    up = F.col("yr") >= F.col("yl")

    def at(y: Column) -> Column:
        x = F.col("xl") + (y - F.col("yl")) / (F.col("yr") - F.col("yl")) * (F.col("xr") - F.col("xl"))
        return F.least(F.greatest(x, F.col("xl")), F.col("xr"))

    lower, upper = F.col("cy") * cell, (F.col("cy") + 1) * cell
    begins = F.when(up, F.col("cy") == F.col("_first")).otherwise(F.col("cy") == F.col("_last"))
    ends = F.when(up, F.col("cy") == F.col("_last")).otherwise(F.col("cy") == F.col("_first"))

    def inside(y: Column) -> Column:
        return F.least(F.greatest(y - lower, F.lit(0.0)), F.lit(cell))

    local = rows.select(
        *keys, "cx", "cy", "sign",
        F.when(begins, F.col("xl")).otherwise(at(F.when(up, lower).otherwise(upper))).alias("xa"),
        F.when(ends, F.col("xr")).otherwise(at(F.when(up, upper).otherwise(lower))).alias("xb"),
        F.when(begins, inside(F.col("yl"))).otherwise(F.when(up, 0.0).otherwise(cell)).alias("ya"),
        F.when(ends, inside(F.col("yr"))).otherwise(F.when(up, cell).otherwise(0.0)).alias("yb"),
    ).filter("xa < xb")
    # a polygon's grid column stays in one task from here: all sums and windows below are by keys, cx and more
    local = cut_lineage(local).repartition(shuffle_width(df.sparkSession), *keys, "cx")
    # where the part of a column that lies under an edge begins and ends, summed down the column per x
    steps = local.select(*keys, "cx", "cy", F.explode(F.array(F.struct(F.col("xa").alias("x"), F.col("sign").alias("d")), F.struct(F.col("xb").alias("x"), (-F.col("sign")).alias("d")))).alias("_s"))
    steps = steps.select(*keys, "cx", "cy", "_s.*").filter(F.col("x") < (F.col("cx") + 1) * cell)
    left = F.col("x") == F.col("cx") * cell
    steps = steps.groupBy(*keys, "cx", "x", "cy").agg(F.sum("d").alias("d"))
    down = Window.partitionBy(*keys, "cx", "x").orderBy(F.col("cy").desc())
    total = F.sum("d").over(down.rowsBetween(Window.unboundedPreceding, 0))
    lids = (
        steps.filter(~left & (F.col("d") != 0))
        .select(*keys, "cx", "x", "cy", total.alias("sign"), F.lead("cy").over(down).alias("_next"))
        .filter("sign <> 0 and _next is not null")
        .select(*keys, "cx", F.explode(F.sequence(F.col("_next"), F.col("cy") - 1)).alias("cy"), "x", "sign")
        .select(*keys, "cx", "cy", "sign", F.col("x").alias("xa"), ((F.col("cx") + 1) * cell).alias("xb"), F.lit(cell).alias("ya"), F.lit(cell).alias("yb"))
    )
    pieces = local.unionByName(lids)
    # the left border tells whether the column is inside below each cell that the outline crosses
    border = pieces.select(*keys, "cx", "cy", F.lit(0.0).alias("d")).unionByName(steps.filter(left).select(*keys, "cx", "cy", "d"))
    border = border.groupBy(*keys, "cx", "cy").agg(F.sum("d").alias("d"))
    column = Window.partitionBy(*keys, "cx").orderBy(F.col("cy").desc())
    below = F.sum("d").over(column.rowsBetween(Window.unboundedPreceding, 0))
    border = border.select(*keys, "cx", "cy", "d", below.alias("_below"), F.lead("cy").over(column).alias("_next"))
    whole = border.filter((F.col("_below") > 0) & (F.col("cy") - F.col("_next") > 1)).select(
        *keys, "cx", (F.col("_next") + 1).alias("lo"), (F.col("cy") - 1).alias("hi"), F.lit(True).alias("full"),
        F.lit(0.0).alias("xa"), F.lit(cell).alias("ya"), F.lit(cell).alias("xb"), F.lit(cell).alias("yb"), F.lit(1.0).alias("sign"),
    )
    corner = border.filter(F.col("_below") != F.col("d")).select(
        *keys, "cx", "cy", (F.col("_below") - F.col("d")).alias("sign"),
        (F.col("cx") * cell).alias("xa"), ((F.col("cx") + 1) * cell).alias("xb"), F.lit(cell).alias("ya"), F.lit(cell).alias("yb"),
    )
    x0 = F.col("cx") * cell
    crossed = pieces.unionByName(corner).select(
        *keys, "cx", F.col("cy").alias("lo"), F.col("cy").alias("hi"), F.lit(False).alias("full"),
        (F.col("xa") - x0).alias("xa"), "ya", (F.col("xb") - x0).alias("xb"), "yb", "sign",
    )
    return cut_lineage(crossed.unionByName(whole))


def piece_area() -> Column:
    return F.col("sign") * (F.col("xb") - F.col("xa")) * (F.col("ya") + F.col("yb")) / 2


def cell_areas(frags: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """keys, cx, lo, hi, full, area (of each cell of the range)."""
    size = float(cell) * cell
    area = frags.groupBy(*keys, "cx", "lo", "hi", "full").agg(F.sum(piece_area()).alias("area"))
    return area.withColumn("area", F.least(F.col("area"), F.lit(size))).filter(F.col("area") > EPS * size)


def areas(frags: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, area of every polygon (or of all polygons of a key, counted once each)."""
    return frags.groupBy(*keys).agg(F.sum(piece_area() * (F.col("hi") - F.col("lo") + 1)).alias("area"))


def _area_below_both(met: DataFrame) -> DataFrame:
    """Adds `_both`, the area below two pieces (a_ and b_ columns) where both stand.

    Step by step: as one expression each height would be worked out many times per pair, in a method too long to be compiled.
    """
    met = met.withColumns({"_p": F.greatest("a_xa", "b_xa"), "_q": F.least("a_xb", "b_xb")}).filter("_p < _q")
    rise = {s: (F.col(f"{s}_yb") - F.col(f"{s}_ya")) / F.nullif(F.col(f"{s}_xb") - F.col(f"{s}_xa"), F.lit(0.0)) for s in ("a", "b")}
    met = met.withColumns({f"_{s}": r for s, r in rise.items()})

    def height(side: str, x: str) -> Column:
        return F.col(f"{side}_ya") + F.col(f"_{side}") * (F.col(x) - F.col(f"{side}_xa"))

    met = met.withColumns({"_ap": height("a", "_p"), "_aq": height("a", "_q"), "_bp": height("b", "_p"), "_bq": height("b", "_q")})
    met = met.withColumns({"_dp": F.col("_ap") - F.col("_bp"), "_dq": F.col("_aq") - F.col("_bq")})
    met = met.withColumns({"_low_p": F.least("_ap", "_bp"), "_low_q": F.least("_aq", "_bq")})
    # where the lines cross it is at share t of the way; there both have the height h
    met = met.withColumn("_t", F.when(F.col("_dp") * F.col("_dq") < 0, F.col("_dp") / F.nullif(F.col("_dp") - F.col("_dq"), F.lit(0.0))))
    met = met.withColumn("_h", F.col("_ap") + F.col("_t") * (F.col("_aq") - F.col("_ap")))
    split = (F.col("_low_p") + F.col("_h")) / 2 * F.col("_t") + (F.col("_h") + F.col("_low_q")) / 2 * (1 - F.col("_t"))
    plain = (F.col("_low_p") + F.col("_low_q")) / 2
    return met.withColumn("_both", (F.col("_q") - F.col("_p")) * F.when(F.col("_t").isNotNull(), split).otherwise(plain))


def _blocks(df: DataFrame) -> DataFrame:
    block = lambda c: F.floor(F.col(c) / BLOCK)
    return df.withColumn("_block", F.explode(F.sequence(block("lo"), block("hi"))))


def _met(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """The join of a and b, where what makes many pairs is dealt over many tasks."""
    left, right = split_full(a, b, on, [c for c, kind in a.dtypes if not kind.startswith("map")])
    return left.join(right, [*on, "_part"]).drop("_part")


def together(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows of a and b (columns a_lo, a_hi, b_lo, b_hi) whose ranges of cells meet, with lo and hi of what they share; no pair twice."""
    left = _blocks(a.withColumns({"lo": F.col("a_lo"), "hi": F.col("a_hi")})).drop("lo", "hi")
    right = _blocks(b.withColumns({"lo": F.col("b_lo"), "hi": F.col("b_hi")})).drop("lo", "hi")
    met = _met(left, right, [*by, "cx", "_block"])
    lo, hi = F.greatest("a_lo", "b_lo"), F.least("a_hi", "b_hi")
    return met.withColumns({"lo": lo, "hi": hi}).filter((F.col("lo") <= F.col("hi")) & (F.floor(F.col("lo") / BLOCK) == F.col("_block"))).drop("_block")


def overlap_areas(a: DataFrame, a_keys: Sequence[str], b: DataFrame, b_keys: Sequence[str], cell: float) -> DataFrame:
    """a_keys, b_keys, area: the exact area that each pair of polygons shares; pairs that share none are left out.

    `a` and `b` are fragments. Polygons of the same key must not overlap each other.
    """
    size = float(cell) * cell
    keys = [*a_keys, *b_keys]

    def side(df: DataFrame, name: str, own: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        """All cells with their areas, and the pieces of the crossed ones."""
        cells = cell_areas(df, own, cell).select(*own, "cx", *[F.col(c).alias(f"{name}_{c}") for c in ("lo", "hi", "full", "area")])
        # they are counted first and joined then
        return cut_lineage(cells), df.filter(~F.col("full")).select(*own, "cx", F.col("lo").alias("cy"), *[F.col(c).alias(f"{name}_{c}") for c in PIECE])

    a_cells, a_pieces = side(a, "a", a_keys)
    b_cells, b_pieces = side(b, "b", b_keys)
    n = F.col("hi") - F.col("lo") + 1
    # one of the two fills the cell: what the other has there
    filled = together(a_cells, b_cells).filter(F.col("a_full") | F.col("b_full")).select(*keys, (n * F.least("a_area", "b_area")).alias("area"))
    crossed = _met(a_pieces, b_pieces, ["cx", "cy"]).filter((F.col("a_xa") < F.col("b_xb")) & (F.col("b_xa") < F.col("a_xb")))
    crossed = _area_below_both(crossed).select(*keys, (F.col("a_sign") * F.col("b_sign") * F.col("_both")).alias("area"))
    return filled.unionByName(crossed).groupBy(*keys).agg(F.sum("area").alias("area")).filter(F.col("area") > EPS * size)


def overlap_sums(a: DataFrame, a_keys: Sequence[str], b: DataFrame, b_keys: Sequence[str], cell: float) -> DataFrame:
    """a_keys, b_keys, area: what each polygon of a shares with all of b's polygons of each key, every one counted for itself.

    Sums over b are made before the join, per cell and over equal pieces, so no row per pair of polygons is made.
    `a` and `b` are fragments; b may carry more keys. Polygons of a of the same key must not overlap each other.
    """
    size = float(cell) * cell
    keys = [*a_keys, *b_keys]
    many = b.groupBy(*b_keys, "cx", "lo", "hi", "full", *PIECE[:4]).agg(F.sum("sign").alias("sign")).filter("sign <> 0")
    many = cut_lineage(many)
    named = lambda df, s, own, cols: df.select(*own, "cx", *[F.col(c).alias(f"{s}_{c}") for c in cols])
    a_cells = cut_lineage(named(cell_areas(a, a_keys, cell), "a", a_keys, ("lo", "hi", "full", "area")))
    held = many.groupBy(*b_keys, "cx", "lo", "hi", "full").agg(F.sum(piece_area()).alias("area")).filter(F.col("area") > EPS * size)
    met = together(a_cells, cut_lineage(named(held, "b", b_keys, ("lo", "hi", "full", "area")))).filter(F.col("a_full") | F.col("b_full"))
    filled = met.select(*keys, (n_cells() * F.col("a_area") * F.col("b_area") / size).alias("area"))
    a_pieces, b_pieces = (named(df.filter(~F.col("full")).withColumn("cy", F.col("lo")), s, [*own, "cy"], PIECE) for df, s, own in ((a, "a", list(a_keys)), (many, "b", list(b_keys))))
    crossed = _area_below_both(_met(a_pieces, b_pieces, ["cx", "cy"])).select(*keys, (F.col("a_sign") * F.col("b_sign") * F.col("_both")).alias("area"))
    return filled.unionByName(crossed).groupBy(*keys).agg(F.sum("area").alias("area")).filter(F.col("area") > EPS * size)


def _strips(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The pieces of each cell once per strip x1..x2 that they cross, with `_y`, their height in its middle.

    Strips lie between neighbouring ends and crossings of a cell's pieces, so within one no two change their order.
    """
    at = [*keys, "cx", "cy"]
    # the slope of a piece and where it meets the left border are worked out once, not per pair
    rise = (F.col("yb") - F.col("ya")) / F.nullif(F.col("xb") - F.col("xa"), F.lit(0.0))
    lines = pieces.select(*at, *PIECE[:4], rise.alias("rise")).withColumn("level", F.col("ya") - F.col("rise") * F.col("xa"))
    one, other = (lines.select(*at, *[F.col(c).alias(f"{s}_{c}") for c in (*PIECE[:4], "rise", "level")]) for s in "ab")
    mark = lambda s: F.struct(*[F.col(f"{s}_{c}") for c in PIECE[:4]])
    met = one.join(other, at).filter((F.col("a_rise") != F.col("b_rise")) & (F.col("a_xa") < F.col("b_xb")) & (F.col("b_xa") < F.col("a_xb")) & (mark("a") < mark("b")))
    cross = (F.col("b_level") - F.col("a_level")) / F.nullif(F.col("a_rise") - F.col("b_rise"), F.lit(0.0))
    met = met.withColumn("x", cross).filter((F.col("x") > F.greatest("a_xa", "b_xa")) & (F.col("x") < F.least("a_xb", "b_xb")))
    ends = pieces.select(*at, F.explode(F.array("xa", "xb")).alias("x")).unionByName(met.select(*at, "x")).distinct()
    across = Window.partitionBy(*at).orderBy("x")
    strips = ends.withColumn("x2", F.lead("x").over(across)).filter("x2 is not null").withColumnRenamed("x", "x1")
    middle = (F.col("x1") + F.col("x2")) / 2
    height = F.col("ya") + (F.col("yb") - F.col("ya")) * (middle - F.col("xa")) / (F.col("xb") - F.col("xa"))
    return strips.join(pieces, at).filter((F.col("xa") <= F.col("x1")) & (F.col("xb") >= F.col("x2"))).withColumn("_y", height)


def layers_in_cells(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, cx, cy and the areas only_a, only_b, both of the unions of layers a and b in each cell.

    `pieces` keys, cx, cy, _layer ('a' or 'b') and PIECE columns.
    """
    at = [*keys, "cx", "cy"]
    rows = _strips(pieces, keys)
    down = Window.partitionBy(*at, "x1").orderBy(F.col("_y").desc())
    covers = {k: F.sum(F.when(F.col("_layer") == k, F.col("sign")).otherwise(0.0)).over(down.rowsBetween(Window.unboundedPreceding, 0)) > 0.5 for k in ("a", "b")}
    rows = rows.withColumns({"_a": covers["a"], "_b": covers["b"], "_down": F.coalesce(F.lead("_y").over(down), F.lit(0.0))})
    part = (F.col("x2") - F.col("x1")) * (F.col("_y") - F.col("_down"))
    pick = lambda c: F.sum(F.when(c, part).otherwise(0.0))
    a, b = F.col("_a"), F.col("_b")
    return rows.groupBy(*at).agg(pick(a & ~b).alias("only_a"), pick(b & ~a).alias("only_b"), pick(a & b).alias("both"))


def ranges_by_layer(rows: DataFrame, keys: Sequence[str], layers: Sequence[str]) -> DataFrame:
    """keys, cx, lo, hi and a count per layer for ranges of cells within which the counts don't change.

    `rows` keys, cx, lo, hi, _layer. Cells that no layer has are left out; neighbours with the same counts are not joined.
    """
    ends = F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).alias("d")))
    steps = rows.select(*keys, "cx", "_layer", F.explode(ends).alias("_e")).select(*keys, "cx", "_layer", "_e.*")
    steps = steps.groupBy(*keys, "cx", "at").agg(*[F.sum(F.when(F.col("_layer") == k, F.col("d")).otherwise(0)).alias(f"_{k}") for k in layers])
    along = Window.partitionBy(*keys, "cx").orderBy("at")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    out = steps.select(*keys, "cx", F.col("at").alias("lo"), (F.lead("at").over(along) - 1).alias("hi"), *[F.sum(f"_{k}").over(so_far).alias(k) for k in layers])
    some = F.lit(False)
    for k in layers:
        some = some | (F.col(k) > 0)
    return out.filter(some & F.col("hi").isNotNull())


def combine(a: DataFrame, b: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """keys, cx, lo, hi and per cell of the range only_a, only_b, both: the union of layer a against that of layer b.

    `a` and `b` are fragments that carry `keys`; whatever polygons of one layer overlap counts once.
    """
    keys, size = list(keys), float(cell) * cell
    columns = [*keys, "cx", "lo", "hi", "full", *PIECE]
    rows = a.select(*columns).withColumn("_layer", F.lit("a")).unionByName(b.select(*columns).withColumn("_layer", F.lit("b")))
    kinds = F.concat(F.when(F.col("full"), "full_").otherwise("part_"), F.col("_layer"))
    marks = rows.select(*keys, "cx", "lo", "hi", kinds.alias("_layer"))
    marks = marks.filter(F.col("_layer").startswith("full")).unionByName(marks.filter(F.col("_layer").startswith("part")).distinct())
    told = cut_lineage(ranges_by_layer(marks, keys, ["full_a", "full_b", "part_a", "part_b"]))
    # a layer that fills a cell leaves nothing to its outlines there
    fills = lambda k: F.col(f"full_{k}") > 0
    open_ = lambda k: (F.col(f"part_{k}") > 0) & ~fills(k)
    settled = told.filter(~open_("a") & ~open_("b")).select(
        *keys, "cx", "lo", "hi",
        F.when(fills("a") & ~fills("b"), size).otherwise(0.0).alias("only_a"),
        F.when(fills("b") & ~fills("a"), size).otherwise(0.0).alias("only_b"),
        F.when(fills("a") & fills("b"), size).otherwise(0.0).alias("both"),
    )
    told_open = told.filter(open_("a") | open_("b")).select(
        *keys, "cx", F.explode(F.sequence("lo", "hi")).alias("cy"), fills("a").alias("_fa"), fills("b").alias("_fb")
    )
    own = rows.filter(~F.col("full")).select(*keys, "cx", F.col("lo").alias("cy"), "_layer", *PIECE)
    own = own.join(told_open, [*keys, "cx", "cy"]).filter(~F.when(F.col("_layer") == "a", F.col("_fa")).otherwise(F.col("_fb"))).drop("_fa", "_fb")
    lid = [F.lit(v).alias(c) for c, v in zip(PIECE, (0.0, float(cell), float(cell), float(cell), 1.0))]
    lids = [told_open.filter(f"_f{k}").select(*keys, "cx", "cy", F.lit(k).alias("_layer"), *lid) for k in ("a", "b")]
    cut = layers_in_cells(cut_lineage(own.unionByName(lids[0]).unionByName(lids[1])), keys)
    cut = cut.select(*keys, "cx", F.col("cy").alias("lo"), F.col("cy").alias("hi"), "only_a", "only_b", "both")
    return settled.unionByName(cut).filter(F.col("only_a") + F.col("only_b") + F.col("both") > EPS * size)


def dissolve(frags: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """Fragments of the union of the polygons of each key: the same area with nothing in it twice.

    Equal pieces are one with the sum of their signs first, so shapes on one spot cost no more than one of them.
    """
    keys, size = list(keys), F.lit(float(cell))
    kind = F.when(F.col("full"), "full").otherwise("part").alias("_layer")
    marks = frags.select(*keys, "cx", "lo", "hi", kind).distinct()
    told = cut_lineage(ranges_by_layer(marks, keys, ["full", "part"]))
    whole = told.filter("full > 0").select(
        *keys, "cx", "lo", "hi", F.lit(True).alias("full"), F.lit(0.0).alias("xa"), size.alias("ya"), size.alias("xb"), size.alias("yb"), F.lit(1.0).alias("sign")
    )
    open_ = told.filter("part > 0 and full = 0").select(*keys, "cx", F.explode(F.sequence("lo", "hi")).alias("cy"))
    at = [*keys, "cx", "cy"]
    own = frags.filter(~F.col("full")).withColumn("cy", F.col("lo")).groupBy(*at, *PIECE[:4]).agg(F.sum("sign").alias("sign")).filter("sign <> 0")
    rows = _strips(cut_lineage(own.join(open_, at, "left_semi")), keys)
    down = Window.partitionBy(*at, "x1").orderBy(F.col("_y").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_deep", F.sum("sign").over(down))
    inside, was = F.col("_deep") > 0.5, F.col("_deep") - F.col("sign") > 0.5
    height = lambda x: F.col("ya") + (F.col("yb") - F.col("ya")) * (F.col(x) - F.col("xa")) / (F.col("xb") - F.col("xa"))
    rims = rows.filter(inside != was).select(
        *keys, "cx", F.col("cy").alias("lo"), F.col("cy").alias("hi"), F.lit(False).alias("full"),
        F.col("x1").alias("xa"), height("x1").alias("ya"), F.col("x2").alias("xb"), height("x2").alias("yb"), F.when(inside, 1.0).otherwise(-1.0).alias("sign"),
    )
    return cut_lineage(whole.unionByName(rims))


def spread(frags: DataFrame, own: Sequence[str], over: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fragments of `frags` (columns `own` are dropped) given the keys of every polygon of `over` whose cells they meet."""
    cells = over.select(*keys, "cx", F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi")).distinct()
    other = frags.select("cx", F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), "full", *PIECE, *own)
    # a range is cut to the cells that it shares, so a border of many small ones does not repeat it
    return together(cells, other).select(*keys, "cx", "lo", "hi", "full", *PIECE, *own)


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """keys, cx, lo, hi, area (per cell) of the union of a's polygons per key less all polygons of b (no keys), which are made one first."""
    left = combine(a, cut_lineage(spread(dissolve(b, [], cell), [], a, keys)), keys, cell).filter(F.col("only_a") > EPS * float(cell) * cell)
    return left.select(*keys, "cx", "lo", "hi", F.col("only_a").alias("area"))


def union(frags: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """keys, cx, lo, hi, area (per cell) of the union of the polygons of each key."""
    none = frags.filter(F.lit(False))
    return combine(frags, none, keys, cell).select(*keys, "cx", "lo", "hi", F.col("only_a").alias("area"))


def total(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, area of ranges of cells with an area per cell."""
    return cells.groupBy(*keys).agg(F.sum(F.col("area") * (F.col("hi") - F.col("lo") + 1)).alias("area"))


def n_cells() -> Column:
    return F.col("hi") - F.col("lo") + 1


def within(a: DataFrame, b: DataFrame, by: Sequence[str], more: Sequence[str]) -> DataFrame:
    """a's ranges of cells (any columns) cut to b's, with columns `more` of b; a row for each of b's ranges that meets one of a's."""
    own = [c for c in a.columns if c not in ("lo", "hi")]
    left = a.withColumnsRenamed({"lo": "a_lo", "hi": "a_hi"})
    right = b.select(*by, "cx", F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), *more)
    return together(left, right, by).select(*own, "lo", "hi", *more)


def left_of(cells: DataFrame, blocked: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """keys, cx, lo, hi, area: what `blocked` (cx, lo, hi, area per cell, no cell twice) leaves of every cell of `cells` (keys, cx, lo, hi)."""
    size = float(cell) * cell
    met = cut_lineage(within(cells.select(*keys, "cx", "lo", "hi"), blocked, [], ["area"]))
    marks = cells.select(*keys, "cx", "lo", "hi", F.lit("all").alias("_layer")).unionByName(met.select(*keys, "cx", "lo", "hi", F.lit("met").alias("_layer")))
    free = ranges_by_layer(marks, keys, ["all", "met"]).filter("all > 0 and met = 0").select(*keys, "cx", "lo", "hi", F.lit(size).alias("area"))
    return free.unionByName(met.filter(F.col("area") < size * (1 - EPS)).withColumn("area", size - F.col("area")))


def covered_by(a: DataFrame, a_keys: Sequence[str], b: DataFrame, b_keys: Sequence[str], cell: float, apart: bool = False) -> DataFrame:
    """a_keys, b_keys, area: how much of a's polygons the union of b's polygons of each key covers; `a` and `b` are fragments.

    The union is made once for all of a. `apart` says that a's polygons of one key don't overlap (as single ones can't).
    """
    mine = a if apart else dissolve(a, a_keys, cell)
    return overlap_areas(mine, a_keys, dissolve(b, b_keys, cell), b_keys, cell)


def disc_runs(points: DataFrame, keys: Sequence[str], x: Column, y: Column, r: Column | float, cell: float) -> DataFrame:
    """keys, cx, lo, hi: per grid column the cells whose centre lies within r of the point."""
    r = r if isinstance(r, Column) else F.lit(float(r))
    base = points.select(*keys, x.alias("_x"), y.alias("_y"), r.alias("_r"))
    base = base.withColumn("cx", F.explode(F.sequence(cell_of(F.col("_x") - F.col("_r"), cell), cell_of(F.col("_x") + F.col("_r"), cell))))
    off = (F.col("cx") + 0.5) * cell - F.col("_x")
    half = F.sqrt(F.col("_r") * F.col("_r") - off * off)
    lo, hi = F.ceil((F.col("_y") - half) / cell - 0.5).cast("int"), F.floor((F.col("_y") + half) / cell - 0.5).cast("int")
    return base.filter(F.abs(off) <= F.col("_r")).select(*keys, "cx", lo.alias("lo"), hi.alias("hi")).filter("lo <= hi")


# ---- stand-off ------------------------------------------------------------------


def disc_ring(x: Column, y: Column, r: Column, sides: int = 32) -> Column:
    """A closed regular polygon round a point, its corners r away."""
    step = F.transform(F.sequence(F.lit(0), F.lit(sides)), lambda i: F.pmod(i, F.lit(sides)) * (6.283185307179586 / sides))
    return F.transform(step, lambda t: F.struct((x + r * F.cos(t)).alias("x"), (y + r * F.sin(t)).alias("y")))


def _wedge_ring(sides: int) -> Column:
    """The sector of `disc_ring` round _p (radius _w) that begins at the angle _from and is _sweep wide; its rim is the disc's."""
    step = 6.283185307179586 / sides
    first, last = F.floor(F.col("_from") / step + 1e-9) + 1, F.ceil((F.col("_from") + F.col("_sweep")) / step - 1e-9) - 1

    def at(angle: Column, r: Column) -> Column:
        return F.struct((F.col("_p.x") + r * F.cos(angle)).alias("x"), (F.col("_p.y") + r * F.sin(angle)).alias("y"))

    def rim(angle: Column) -> Column:
        off = angle - (F.floor(angle / step) + 0.5) * step
        return F.array(at(angle, F.col("_w") * F.cos(F.lit(step / 2)) / F.cos(off)))

    between = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    corners = F.transform(between, lambda k: at(F.pmod(k, F.lit(sides)) * step, F.col("_w")))
    middle = F.array(F.struct(F.col("_p.x").alias("x"), F.col("_p.y").alias("y")))
    return F.concat(middle, rim(F.col("_from")), corners, rim(F.col("_from") + F.col("_sweep")), middle)


def standoff(df: DataFrame, keys: Sequence[str], width: Column | float, lines: str = "rings", sides: int = 32) -> DataFrame:
    """keys, rings: convex shapes that, together with the shape itself, make up what lies no farther than `width`.

    A rectangle along every edge of `lines` (an array of rings or lines), and of the disc at every vertex what they leave:
    the sector on the outer side of the turn, or the whole disc at the ends of a line and beside edges shorter than
    `width`. Their union is left to the overlay, which counts what overlaps once. Widths of 0 and less give nothing.
    """
    keys = list(keys)
    lines_ = df.select(*keys, (width if isinstance(width, Column) else F.lit(float(width))).alias("_w"), F.explode(lines).alias("_line")).filter("_w > 0")
    n, line = F.size("_line"), F.col("_line")
    none = F.array(F.when(F.lit(False), line[0]))
    closed = (n > 2) & (line[0] == line[n - 1])
    own = F.when(closed, F.slice(line, 1, n - 1)).otherwise(line)
    before = F.when(closed, F.concat(F.slice(line, n - 1, 1), F.slice(line, 1, n - 2))).otherwise(F.concat(none, F.slice(line, 1, n - 1)))
    after = F.when(closed, F.slice(line, 2, n - 1)).otherwise(F.concat(F.slice(line, 2, n - 1), none))
    corners = F.arrays_zip(own.alias("p"), before.alias("b"), after.alias("n"))
    turns = lines_.filter(n > 0).select(*keys, "_w", corners.alias("_c")).select(*keys, "_w", F.explode("_c").alias("_t"))
    turns = turns.select(*keys, "_w", F.col("_t.p").alias("_p"), F.col("_t.b").alias("_b"), F.col("_t.n").alias("_n")).distinct()
    ix, iy, ox, oy = (F.col(f"{b}.{c}") - F.col(f"{a}.{c}") for a, b in (("_b", "_p"), ("_p", "_n")) for c in "xy")
    long = F.coalesce((F.hypot(ix, iy) >= F.col("_w")) & (F.hypot(ox, oy) >= F.col("_w")), F.lit(False))
    left = ix * oy - iy * ox
    turns = turns.withColumns({
        "_long": long, "_sweep": F.abs(F.atan2(left, ix * ox + iy * oy)), "_from": F.when(left >= 0, F.atan2(-ix, iy)).otherwise(F.atan2(ox, -oy)),
    })
    discs = turns.filter(~F.col("_long")).select(*keys, "_w", "_p").distinct()
    discs = discs.select(*keys, F.array(disc_ring(F.col("_p.x"), F.col("_p.y"), F.col("_w"), sides)).alias("rings"))
    wedges = turns.filter(F.col("_long") & (F.col("_sweep") > 1e-12)).select(*keys, F.array(_wedge_ring(sides)).alias("rings"))
    pairs = F.zip_with(F.slice("_line", 1, n - 1), F.slice("_line", 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    sides_ = lines_.filter(n > 1).select(*keys, "_w", F.explode(pairs).alias("_e")).select(*keys, "_w", "_e.a", "_e.b")
    sides_ = sides_.withColumn("_l", F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"))).filter("_l > 0")
    dx, dy = (F.col("_w") * (F.col(f"b.{c}") - F.col(f"a.{c}")) / F.col("_l") for c in "xy")
    corner = lambda p, s: F.struct((F.col(f"{p}.x") - s * dy).alias("x"), (F.col(f"{p}.y") + s * dx).alias("y"))
    box = F.array(corner("a", -1), corner("b", -1), corner("b", 1), corner("a", 1), corner("a", -1))
    return discs.unionByName(wedges).unionByName(sides_.select(*keys, F.array(box).alias("rings")))
