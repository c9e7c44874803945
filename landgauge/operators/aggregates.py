"""Grouped measures: catchment scores, composition, imputation, series, planning sums."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgauge.operators import overlay
from landgauge.operators.ordering import first_per, medians


def weighted_mean(v: Column, w: Column) -> Column:
    """Aggregate: sum(v*w) over the weights whose value is known."""
    return F.sum(v * w) / F.nullif(F.sum(F.when(v.isNotNull(), w)), F.lit(0.0))


def gated(stat: Column, n: Column, k: int) -> Column:
    return F.when(n >= k, stat)


# Amenity points per kind present, and per bus stop up to ten.
AMENITY_KINDS = ("gp", "pharmacy", "school", "nursery")
KIND_POINTS, BUS_CAP = 20, 10


def amenity_score(counts: dict[str, Column]) -> Column:
    parts = [F.when(F.coalesce(counts[k], F.lit(0)) >= 1, KIND_POINTS).otherwise(0) for k in AMENITY_KINDS]
    bus = F.least(F.coalesce(counts["bus"], F.lit(0)), F.lit(BUS_CAP)) / F.lit(BUS_CAP) * KIND_POINTS
    return reduce(lambda a, b: a + b, parts) + bus


def snap_grid(df: DataFrame, x: str, y: str, avg: str, top: str, step: float, keys: Sequence[str] = ()) -> DataFrame:
    """Regular cells re-binned to a coarser step: mean, best of (max else mean), count."""
    return df.groupBy(
        *keys, F.floor(F.col(x) / step).cast("int").alias("gx"), F.floor(F.col(y) / step).cast("int").alias("gy")
    ).agg(F.avg(avg).alias("mean"), F.max(F.coalesce(F.col(top), F.col(avg))).alias("top"), F.count(F.lit(1)).alias("n"))


def block_best_case(df: DataFrame, e: str, n: str, res: float, mins: Sequence[str], maxs: Sequence[str]) -> DataFrame:
    """Coarser block with the best value of every attribute inside it."""
    return df.groupBy(
        F.floor(F.col(e) / res).cast("int").alias("be"), F.floor(F.col(n) / res).cast("int").alias("bn")
    ).agg(
        *[F.min(c).alias(c) for c in mins], *[F.max(c).alias(c) for c in maxs],
        F.avg(e).alias("mid_e"), F.avg(n).alias("mid_n"), F.count(F.lit(1)).alias("n_cells"),
    )


def cell_composition(polygons: DataFrame, groups: dict[str, Sequence[str]], cell: float) -> DataFrame:
    """gx, gy and the percent of each cell under each group of kinds (exact union within a group).

    `polygons` kind, rings.
    """
    label = F
    for name, kinds in groups.items():
        label = label.when(F.col("kind").isin(*kinds), name)
    grouped = polygons.select(label.alias("_g"), "rings").filter(F.col("_g").isNotNull())
    union = overlay.union(overlay.fragments(grouped, ["_g"], cell), ["_g"], cell)
    cells = union.select("_g", F.col("cx").alias("gx"), F.explode(F.sequence("lo", "hi")).alias("gy"), "area")
    pct = lambda g: F.round(F.sum(F.when(F.col("_g") == g, F.col("area")).otherwise(0.0)) / (cell * cell) * 100).cast("int")
    return cells.groupBy("gx", "gy").agg(*[F.least(F.lit(100), pct(g)).alias(f"{g}_pct") for g in groups])


def aggregate_titles(titles: DataFrame) -> DataFrame:
    """Titles per (postcode, owner): counts, and the first land address in file order."""
    land = ~F.col("is_flat")
    return titles.groupBy("postcode", "owner").agg(
        F.count(F.lit(1)).alias("titles"),
        F.count_if(F.col("is_flat")).alias("titles_flat"),
        F.count_if(land).alias("titles_land"),
        F.min_by(F.when(land, F.col("address")), F.when(land, F.col("ord"))).alias("address"),
        (F.count_if(land) > 0).alias("has_land"),
    )


def impute_rooms(hotels: DataFrame, min_brand: int = 5, default: int = 10) -> DataFrame:
    """Rooms: tagged, else brand median, else footprint fit, else type median; beds are twice that.

    Medians and the fitted line are small derived tables joined back.
    """
    valid = F.col("tagged").between(1, 2000)
    tagged = hotels.filter(valid)
    brand = medians(tagged.filter("brand is not null"), ["brand"], {"r": F.col("tagged")}).filter(F.col("r_n") >= min_brand)
    kind = medians(tagged, ["kind"], {"t": F.col("tagged")}).select("kind", F.col("t_med").alias("_type_med"))
    fit = footprint_fit(tagged.withColumn("_x", F.col("area") * F.coalesce("levels", F.lit(3))), "_x", "tagged")
    joined = (
        hotels.join(brand.select("brand", F.col("r_med").alias("_brand_med")), "brand", "left")
        .join(kind, "kind", "left")
        .withColumn("_fit", fit.select(F.struct("slope", "scale")).scalar())
    )
    floor_area = F.col("area") * F.least(F.coalesce(F.col("levels"), F.lit(3)), F.lit(40))
    by_area = F.when(
        F.col("area") > 80,
        F.greatest(F.lit(5), F.least(F.lit(1500), F.round(F.col("_fit.scale") * F.pow(floor_area, F.col("_fit.slope"))))),
    )
    rooms = F.coalesce(
        F.when(valid, F.col("tagged")), F.round("_brand_med"), by_area, F.round(F.coalesce("_type_med", F.lit(default)))
    ).cast("int")
    src = (
        F.when(valid, "tagged").when(F.col("_brand_med").isNotNull(), "brand").when(by_area.isNotNull(), "footprint").otherwise("typical")
    )
    return joined.withColumn("rooms", rooms).withColumn("rooms_src", src).withColumn("beds", F.col("rooms") * 2).drop(
        "_brand_med", "_type_med", "_fit"
    )


# Fallback room density and the allowed slope range of the fit.
FIT_MIN_N, FIT_SCALE, FIT_SLOPE = 30, 0.65 / 30, (0.3, 1.0)


def footprint_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, slope (clamped) and scale of y = scale * x^slope by log-log least squares."""
    lx, ly = F.log(F.col(x).cast("double")), F.log(F.col(y).cast("double"))
    s = df.filter((F.col(x) > 0) & (F.col(y) > 0)).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(ly, lx).alias("raw"), F.avg(lx).alias("mx"), F.avg(ly).alias("my")
    )
    slope = F.greatest(F.lit(FIT_SLOPE[0]), F.least(F.lit(FIT_SLOPE[1]), F.col("raw")))
    ok = F.col("n") >= FIT_MIN_N
    return s.select(
        "n",
        F.when(ok, slope).otherwise(1.0).alias("slope"),
        F.when(ok, F.exp(F.col("my") - slope * F.col("mx"))).otherwise(FIT_SCALE).alias("scale"),
    )


def uprate(df: DataFrame, index: DataFrame, year: str, amount: str, out: str) -> DataFrame:
    """Amounts of a year at the index's latest year; unknown years stay null."""
    latest = index.agg(F.max_by("rpi", "year").alias("rpi")).scalar()
    return (
        df.join(index.select(F.col("year").alias(year), "rpi"), year, "left")
        .withColumn("_now", latest)
        .withColumn(out, F.col(amount) * F.col("_now") / F.col("rpi"))
        .drop("rpi", "_now")
    )


def consensus(figures: DataFrame, score: str = "score", tie: str = "fig_id") -> DataFrame:
    """Latest figure per (zone, tier, agent), then mean and sorted values per (zone, tier)."""
    latest = figures.groupBy("zone", "tier", "agent").agg(F.max_by("rent", F.struct(score, -F.col(tie))).alias("rent"))
    return latest.groupBy("zone", "tier").agg(
        F.avg("rent").alias("mean_rent"),
        F.count(F.lit(1)).alias("n_agents"),
        # one figure per agent by now, so the list is as long as the agent panel
        F.sort_array(F.collect_list("rent"), asc=False).alias("figures"),
    )


def pack_series(obs: DataFrame, keys: Sequence[str], month: str, value: str) -> DataFrame:
    """Dense monthly arrays per key: first_period, values (null where a month has none).

    `obs` holds one row per key and month; the calendar bounds the array.
    """
    span = obs.groupBy(*keys).agg(F.min(month).alias("first_period"), F.max(month).alias("_last"))
    grid = span.withColumn(month, F.explode(F.sequence("first_period", "_last", F.expr("interval 1 month"))))
    full = grid.join(obs.select(*keys, month, value), [*keys, month], "left")
    packed = F.sort_array(F.collect_list(F.struct(month, value)))
    return full.groupBy(*keys, "first_period").agg(F.transform(packed, lambda s: s[value]).alias("values"))


def unpack_series(packed: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return packed.select(*keys, "first_period", F.posexplode("values").alias("_pos", value)).select(
        *keys, F.add_months("first_period", F.col("_pos")).alias("month"), value
    )


def growth_pct(values: Column, months: int) -> Column:
    """Percent change over the last `months` entries, 1 dp."""
    n = F.size(values)
    now, then = F.element_at(values, -1), F.try_element_at(values, n - months)
    return F.when((n > months) & (then > 0), F.round((now / then - 1) * 100, 1))


def rollup_scores(df: DataFrame, key: str, scores: Sequence[str], weight: str) -> DataFrame:
    w = F.when(F.col(weight) > 0, F.col(weight)).otherwise(1.0)
    return df.groupBy(key).agg(*[weighted_mean(F.col(s), w).alias(s) for s in scores])


def approval_rates(apps: DataFrame, keys: Sequence[str], state: str, min_decided: int = 5) -> DataFrame:
    """Counts by state group and the approval percentage once enough are decided."""
    counts = apps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(state) == "approved").alias("approved"),
        F.count_if(F.col(state) == "refused").alias("refused"),
        F.count_if(F.col(state) == "pending").alias("pending"),
    )
    decided = F.col("approved") + F.col("refused")
    return counts.withColumn("approval_pct", gated(F.round(100 * F.col("approved") / decided, 1), decided, min_decided))


# The standard method's stock share, ratio floor and slope.
STOCK_SHARE, RATIO_FLOOR, RATIO_SLOPE, BELOW_PCT = 0.008, 5.0, 0.95, 80


def housing_need(stock: Column, ratio: Column) -> tuple[Column, Column]:
    """(affordability factor, yearly homes needed)."""
    factor = F.when(ratio <= RATIO_FLOOR, 1.0).otherwise((ratio - RATIO_FLOOR) / RATIO_FLOOR * RATIO_SLOPE + 1.0)
    return factor, stock * STOCK_SHARE * factor


# Plan stages, least to most advanced.
PLAN_STAGES = ("", "draft", "submitted", "examined", "adopted")


def plan_gap(plans: DataFrame, housing: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """Best plan per boundary with supply, shortfall, percent met, age and last event."""
    rows = plans.join(housing, "plan", "left")
    complete = F.col("required").isNotNull() & F.col("allocated").isNotNull() & F.col("committed").isNotNull()
    stage = F.array_position(F.array(*[F.lit(s) for s in PLAN_STAGES]), F.coalesce("stage", F.lit("")))
    order = F.struct(complete, F.col("has_row").isNotNull(), stage, F.col("adopted"), F.col("period_end"), F.col("plan"))
    cols = ["plan", "adopted", "required", "allocated", "committed", "windfall"]
    best = rows.groupBy("boundary").agg(F.max_by(F.struct(*cols), order).alias("b")).select("boundary", "b.*")
    last = events.groupBy("plan").agg(F.max_by(F.struct("event", "event_date"), F.struct("event_date", "event")).alias("e"))
    supply = F.col("allocated") + F.col("committed") + F.coalesce("windfall", F.lit(0))
    known = F.col("required").isNotNull() & supply.isNotNull()
    any_known = F.coalesce("required", "allocated", "committed", "windfall").isNotNull()
    return best.join(last, "plan", "left").select(
        "boundary", "plan", F.col("e.event").alias("last_event"),
        F.when(known, supply).alias("supply"),
        F.when(known, F.greatest(F.lit(0), F.col("required") - supply)).alias("gap"),
        F.when(known & (F.col("required") > 0), F.round(100 * supply / F.col("required"), 1)).alias("pct_met"),
        F.round(F.datediff(as_of, "adopted") / 365.25, 1).alias("plan_age_yrs"),
        F.when(known, "has_numbers").when(any_known, "partial_supply").otherwise("plan_only").alias("status"),
    )


def junction_flow(links: DataFrame) -> DataFrame:
    """Nodes with three or more links of two or more roads: half the summed flow."""
    ends = links.select("road", "flow", F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("node").agg(
        F.count(F.lit(1)).alias("n_links"), F.count_distinct("road").alias("n_roads"), (F.sum("flow") / 2).alias("flow")
    ).filter((F.col("n_links") >= 3) & (F.col("n_roads") >= 2))


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_l")).select(*keys, "_l.*")


def headroom(df: DataFrame, ratings: str, demand: str, cls: str) -> DataFrame:
    """N-1 rating of a comma list minus maximum demand; HOT sites are left out."""
    vals = F.filter(F.transform(F.split(F.replace(F.col(ratings), F.lit(" "), F.lit("")), ","), lambda s: s.try_cast("double")), lambda v: v.isNotNull())
    total = F.aggregate(vals, F.lit(0.0), lambda a, v: a + v)
    firm = F.when(F.size(vals) > 1, total - F.array_max(vals)).otherwise(F.array_max(vals))
    return df.filter(F.coalesce(F.col(cls), F.lit("")) != "HOT").withColumn("headroom", firm - F.col(demand)).filter(F.col("headroom").isNotNull())


def latest_populated(df: DataFrame, key: str, periods: Sequence[str], min_n: int) -> DataFrame:
    """Values of the rightmost period column that holds at least min_n coded values."""
    long = df.select(key, F.posexplode(F.array(*[F.col(p).cast("double") for p in periods])).alias("_pos", "value")).filter(
        F.col("value").isNotNull()
    )
    last = long.groupBy("_pos").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_n).agg(F.max("_pos").alias("p"))
    names = F.array(*[F.lit(p) for p in periods])
    return (
        long.withColumn("_last", last.scalar())
        .filter(F.col("_pos") == F.col("_last"))
        .select(key, names[F.col("_pos")].alias("period"), "value")
    )


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    if keys:
        return first_per(df, keys, order, n)
    return df.orderBy(*order).limit(n)


def slope_blocks(grid: DataFrame, cell: float, block: float, min_valid: float = 0.5) -> DataFrame:
    """Mean and maximum slope (degrees, central difference) per block of an x, y, z grid."""
    # every point tells its four neighbours its height: one shuffle, no ordering
    told = F.array(
        *[
            F.struct((F.col("x") + dx * cell).alias("x"), (F.col("y") + dy * cell).alias("y"), F.lit(tag).alias("from"), F.col("z").alias("z"))
            for dx, dy, tag in ((0, 0, "own"), (-1, 0, "east"), (1, 0, "west"), (0, -1, "north"), (0, 1, "south"))
        ]
    )
    tags = ("own", "east", "west", "north", "south")
    g = (
        grid.select(F.explode(told).alias("t"))
        .groupBy("t.x", "t.y")
        .agg(*[F.max(F.when(F.col("t.from") == tag, F.col("t.z"))).alias(tag) for tag in tags])
        .filter(F.col("own").isNotNull())
    )
    rise = F.hypot((F.col("east") - F.col("west")) / (2 * cell), (F.col("north") - F.col("south")) / (2 * cell))
    slope = F.degrees(F.atan(rise))
    per = g.withColumn("s", slope).groupBy(
        F.floor(F.col("x") / block).cast("int").alias("bx"), F.floor(F.col("y") / block).cast("int").alias("by")
    ).agg(F.avg("s").alias("mean_slope"), F.max("s").alias("max_slope"), F.count("s").alias("n_valid"))
    return per.filter(F.col("n_valid") >= min_valid * (block / cell) ** 2)
