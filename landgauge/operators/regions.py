"""Raster regions as runs of cells along grid columns: opening, parts and holes.

A region is keys, cx, lo, hi: cells lo..hi of column cx. Runs of one key and
column must neither overlap nor touch; `merge` sees to it. The work grows with the
number of runs, so the outline counts and not the area.

A disc of k cells is handled column by column: in a column i away it reaches
floor(sqrt(k*k - i*i)) cells up and down. A cell survives erosion if all 2k+1
columns have it after they were shortened by that much, and dilation joins the
lengthened ones, so a run is repeated 2k+1 times and never (2k+1) squared times.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landgauge.operators.graph import components
from landgauge.session import cut_lineage


def _covered(runs: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Runs of the cells that at least `least` of the given (overlapping) runs have."""
    at = [*keys, "cx"]
    ends = F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).alias("d")))
    steps = runs.filter("lo <= hi").select(*at, F.explode(ends).alias("_e")).groupBy(*at, F.col("_e.at").alias("at")).agg(F.sum("_e.d").alias("d"))
    along = Window.partitionBy(*at).orderBy("at")
    deep = F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0)) >= least
    marked = steps.select(*at, "at", deep.alias("in"))
    turns = marked.withColumn("_was", F.coalesce(F.lag("in").over(along), F.lit(False))).filter(F.col("in") != F.col("_was"))
    return turns.select(*at, F.col("at").alias("lo"), (F.lead("at").over(along) - 1).alias("hi"), "in").filter("in").drop("in")


def merge(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The union of runs that may overlap or touch."""
    return _covered(runs.select(*keys, "cx", "lo", "hi"), keys, 1)


def runs_of(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of single cells keys, cx, cy; repeated cells count once.

    Cells are sorted once along their column; only those at the ends of a run go on.
    """
    along = Window.partitionBy(*keys, "cx").orderBy("cy")
    before, after = F.lag("cy").over(along), F.lead("cy").over(along)
    ends = cells.select(
        *keys, "cx", "cy", F.coalesce(before < F.col("cy") - 1, F.lit(True)).alias("_first"), F.coalesce(after > F.col("cy") + 1, F.lit(True)).alias("_last")
    ).filter("_first or _last")
    whole = ends.withColumn("hi", F.when(F.col("_last"), F.col("cy")).otherwise(F.lead("cy").over(along)))
    return whole.filter("_first").select(*keys, "cx", F.col("cy").alias("lo"), "hi")


def cells_of(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return runs.select(*keys, "cx", F.explode(F.sequence("lo", "hi")).alias("cy"))


def size_of(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n_cells"""
    return runs.groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n_cells"))


def _shifts(k: float) -> list[tuple[int, int]]:
    """(columns away, cells up and down) of a disc of radius k."""
    n = int(k)
    return [(i, int(math.sqrt(k * k - i * i))) for i in range(-n, n + 1)]


def _shifted(runs: DataFrame, keys: Sequence[str], k: float, sign: int) -> DataFrame:
    moves = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(sign * h).alias("h")) for i, h in _shifts(k)])
    rows = runs.select(*keys, "cx", "lo", "hi", F.explode(moves).alias("_m"))
    return rows.select(*keys, (F.col("cx") + F.col("_m.i")).alias("cx"), (F.col("lo") - F.col("_m.h")).alias("lo"), (F.col("hi") + F.col("_m.h")).alias("hi"))


def erode(runs: DataFrame, keys: Sequence[str], k: float) -> DataFrame:
    """Cells whose whole disc of k cells lies in the region."""
    return _covered(_shifted(runs, keys, k, -1), keys, 2 * int(k) + 1)


def dilate(runs: DataFrame, keys: Sequence[str], k: float) -> DataFrame:
    """Cells within k cells of the region."""
    return _covered(_shifted(runs, keys, k, 1), keys, 1)


def opening(runs: DataFrame, keys: Sequence[str], k: float) -> DataFrame:
    """Erosion, then dilation: what a disc of k cells that stays inside the region can reach."""
    return dilate(erode(runs, keys, k), keys, k)


def common(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The cells that both regions have."""
    return _covered(a.select(*keys, "cx", "lo", "hi").unionByName(b.select(*keys, "cx", "lo", "hi")), keys, 2)


def touching(runs: DataFrame, keys: Sequence[str], run: str = "run") -> DataFrame:
    """u, v: runs of neighbouring columns that share an edge of some cell.

    Of two runs that meet, the later start lies in the other one, so each start only has to look for the last run of
    the neighbouring column that starts no later. Both columns go through one window.
    """
    own = runs.select(*keys, F.col("cx").alias("_c"), "lo", "hi", F.col(run).alias("_r"), F.lit(0).alias("_side"))
    before = runs.select(*keys, (F.col("cx") + 1).alias("_c"), "lo", "hi", F.col(run).alias("_r"), F.lit(1).alias("_side"))
    both = own.unionByName(before)
    # of equal starts each has to see the other, so the side that is looked for goes first
    pairs = []
    for side in (0, 1):
        along = Window.partitionBy(*keys, "_c").orderBy("lo", F.when(F.col("_side") == side, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
        seen = F.last(F.when(F.col("_side") == side, F.struct("_r", "hi")), ignorenulls=True).over(along)
        found = both.withColumn("_o", seen).filter((F.col("_side") != side) & (F.col("_o.hi") >= F.col("lo")))
        pairs.append(found.select(F.least("_r", "_o._r").alias("u"), F.greatest("_r", "_o._r").alias("v")))
    return pairs[0].unionByName(pairs[1]).distinct()


def parts(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds `part` (a number): the component of each run, by cells that share an edge."""
    numbered = cut_lineage(runs.select(*keys, "cx", "lo", "hi").withColumn("run", F.monotonically_increasing_id()))
    label = components(cut_lineage(touching(numbered, keys)), nodes=numbered.select(F.col("run").alias("node")))
    return numbered.join(label.select(F.col("node").alias("run"), F.col("component").alias("part")), "run").drop("run")


def gaps(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, cx, lo, hi, open: the cells between the runs of a column; `open` where the next column has no run beside it.

    What lies above and below a column's runs is outside and left out, and so are columns without runs.
    """
    along = Window.partitionBy(*keys, "cx").orderBy("lo")
    between = runs.select(*keys, "cx", (F.col("hi") + 1).alias("lo"), (F.lead("lo").over(along) - 1).alias("hi")).filter("hi is not null")
    span = runs.groupBy(*keys, "cx").agg(F.min("lo").alias("_least"), F.max("hi").alias("_most"))
    out = between
    for step in (-1, 1):
        beside = span.select(*keys, (F.col("cx") + step).alias("cx"), F.col("_least").alias(f"_a{step + 1}"), F.col("_most").alias(f"_b{step + 1}"))
        out = out.join(beside, [*keys, "cx"], "left")
    free = F.lit(False)
    for s in (0, 2):
        free = free | F.col(f"_a{s}").isNull() | (F.col("lo") < F.col(f"_a{s}")) | (F.col("hi") > F.col(f"_b{s}"))
    return out.select(*keys, "cx", "lo", "hi", free.alias("open"))


def holes(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, cx, lo, hi, part, n_cells: the enclosed gaps of a region (cells that no way over cell edges leads out of)."""
    inner = cut_lineage(gaps(runs, keys))
    labelled = cut_lineage(parts(inner, keys).join(inner, [*keys, "cx", "lo", "hi"]))
    sizes = labelled.groupBy("part").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n_cells"), F.max("open").alias("_open")).filter("not _open")
    return labelled.drop("open").join(sizes.drop("_open"), "part").select(*keys, "cx", "lo", "hi", "part", "n_cells")


def fill_holes(runs: DataFrame, keys: Sequence[str], most_cells: float) -> DataFrame:
    """The region with its holes of at most `most_cells` cells filled."""
    small = holes(runs, keys).filter(F.col("n_cells") <= most_cells).select(*keys, "cx", "lo", "hi")
    return merge(runs.select(*keys, "cx", "lo", "hi").unionByName(small), keys)
