"""Viewport, property, hygiene and sift filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgauge.functions.clean import json_number
from landgauge.operators.ordering import first_per


def all_of(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def in_bbox(
    df: DataFrame, box: tuple[float, float, float, float], kind: str, size: str, key: str, per_kind: int, overall: int
) -> DataFrame:
    """Rows whose envelope meets the box, biggest first, capped per kind and overall."""
    w, s, e, n = box
    hit = df.filter((F.col("minx") <= e) & (F.col("maxx") >= w) & (F.col("miny") <= n) & (F.col("maxy") >= s))
    order = [F.col(size).desc_nulls_last(), F.col(key)]
    return first_per(hit, [kind], order, per_kind).orderBy(*order).limit(overall)


def prop_range(props: Column, key: str, lo: float | None, hi: float | None) -> Column:
    """A missing value fails a minimum but passes a maximum."""
    v = json_number(props, key)
    conds = []
    if lo is not None:
        conds.append(F.coalesce(v >= lo, F.lit(False)))
    if hi is not None:
        conds.append(v.isNull() | (v < hi))
    return all_of(conds)


def sites_filter(
    df: DataFrame, kinds: Sequence[str] | None = None, min_dwellings: int | None = None,
    public_only: bool = False, deliverable_only: bool = False,
) -> DataFrame:
    if kinds is not None:
        df = df.filter(F.col("kind").isin(*kinds))
    if min_dwellings is not None:
        df = df.filter(F.coalesce("max_dwellings", "min_dwellings", F.lit(0)) >= min_dwellings)
    if public_only:
        df = df.filter(F.coalesce("is_public", F.lit(False)))
    if deliverable_only:
        df = df.filter(F.coalesce("deliverable", F.lit(False)))
    return df


def clean_sales(df: DataFrame, months: int, as_of: Column) -> DataFrame:
    """Standard sales inside the window with a postcode and a whole-pound price; ids once."""
    return df.filter(
        (F.col("category") == "A")
        & (F.col("sold") >= F.add_months(as_of, -months))
        & F.col("postcode").isNotNull()
        & F.col("price_text").rlike("^[0-9]+$")
    ).dropDuplicates(["sale_id"])


# Plausible ranges of the published figures.
BOUNDS = {"m2": (15, 600), "ppm2": (300, 30000), "rate_pm2": (20, 3000)}


def plausible(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return df.filter(all_of([F.col(c).between(*b) for c, b in bounds.items()]))


def require_rows(df: DataFrame, n: int, what: str) -> DataFrame:
    """Refuses (at run time) to pass on a table with fewer than n rows."""
    enough = df.agg(F.count(F.lit(1)).alias("n")).select(
        F.when(F.col("n") >= n, True).otherwise(F.raise_error(F.lit(f"{what}: fewer than {n} rows")).cast("boolean"))
    )
    return df.withColumn("_ok", enough.scalar()).filter("_ok").drop("_ok")


def active_services(calendar: DataFrame, exceptions: DataFrame, day: Column) -> DataFrame:
    """Service ids running on `day`: weekday flag within dates, plus added, minus removed."""
    flags = F.array(*[F.col(d) for d in ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")])
    base = calendar.filter(day.between(F.col("start_date"), F.col("end_date")) & (flags[F.dayofweek(day) - 1] == 1)).select("service_id")
    today = exceptions.filter(F.col("date") == day)
    added = today.filter("exception_type = 1").select("service_id")
    removed = today.filter("exception_type = 2").select("service_id")
    return base.union(added).distinct().join(removed, "service_id", "left_anti")


def pick_day(start: Column, weekday: str) -> Column:
    """First given weekday on or after `start`."""
    return F.next_day(F.date_sub(start, 1), weekday)


# Overlay precedence of schedule kinds.
OVERLAY_RANK = {"C": 3, "N": 2, "O": 1, "P": 0}


def resolve_schedules(df: DataFrame, day: Column) -> DataFrame:
    """The one schedule per train that applies on `day`; cancelled and non-passenger ones drop."""
    runs = df.filter(day.between(F.col("runs_from"), F.col("runs_to")))
    rank = F.create_map(*[F.lit(x) for kv in OVERLAY_RANK.items() for x in kv])[F.col("stp")]
    best = first_per(runs.withColumn("_rank", rank), ["uid"], [F.col("_rank").desc(), F.col("ord").desc()])
    return best.filter((F.col("stp") != "C") & F.col("passenger")).drop("_rank")


# ---- grid sift -------------------------------------------------------------

# Default switches and limits of the grid sift.
SIFT_DEFAULTS = {
    "ex_built": True, "built_max": 10, "ex_transport": True, "transport_max": 20, "ex_water": True, "water_max": 20,
    "ex_protected": True, "protected_max": 5, "ex_heritage": False, "heritage_max": 10, "ex_flood3": True, "flood3_max": 10,
    "ex_flood2": False, "flood2_max": 10, "ex_green_belt": False, "green_belt_max": 25, "ex_farmland": False, "farmland_max": 25,
    "ex_air": False, "max_slope": 50, "power": "d_sub132", "power_max": 50, "avoid_queue": False, "queue_max": 20,
    "use_settlement": False, "settlement": "d_set20", "settlement_max": 100, "use_heat": False, "heat_max": 50,
}
NOTHING_NEAR = 255


def sift_grid(df: DataFrame, params: dict | None = None) -> DataFrame:
    p = {**SIFT_DEFAULTS, **(params or {})}
    conds = [F.col("slope10") <= p["max_slope"]]
    for name in ("built", "transport", "water", "protected", "heritage", "green_belt", "farmland"):
        if p[f"ex_{name}"]:
            conds.append(F.col(f"{name}_pct") <= p[f"{name}_max"])
    for name in ("flood3", "flood2"):
        if p[f"ex_{name}"]:
            conds.append(F.greatest(F.col(f"{name}_pct"), F.lit(0)) <= p[f"{name}_max"])
    if p["ex_air"]:
        conds.append(F.col("aqma") == 0)
    power = F.col(p["power"])
    if p["power"].startswith("d_dno"):
        # no operator data in a licence area is not a failure
        power = F.when(power == NOTHING_NEAR, 0).otherwise(power)
    conds.append(power <= p["power_max"])
    if p["avoid_queue"]:
        conds.append(F.col("gsp_mw") <= p["queue_max"])
    if p["use_settlement"]:
        conds.append(F.col(p["settlement"]) <= p["settlement_max"])
    if p["use_heat"]:
        conds.append(F.col("d_heat") <= p["heat_max"])
    return df.filter(all_of(conds))


def with_distance(df: DataFrame, x0: float, y0: float, bands: Sequence[float]) -> DataFrame:
    d = F.hypot(F.col("x") - x0, F.col("y") - y0)
    band = F
    for b in bands:
        band = band.when(d <= b, F.lit(float(b)))
    return df.withColumn("dist", d).withColumn("band", band.otherwise(F.lit(None).cast("double")))


def token_in(col: Column, token: str, sep: str = ", ") -> Column:
    return F.coalesce(F.array_contains(F.split(col, sep), token), F.lit(False))


def study_filter(
    df: DataFrame, min_capacity: int = 1000, sports: Sequence[str] | None = None, nation: str | None = None, modern_from: int | None = None
) -> DataFrame:
    conds = [F.col("capacity") >= min_capacity]
    if sports is not None:
        conds.append(F.col("sport").isin(*sports))
    if nation is not None:
        conds.append(F.col("nation") == nation)
    if modern_from is not None:
        conds.append(F.col("opened") >= modern_from)
    return df.filter(all_of(conds))
