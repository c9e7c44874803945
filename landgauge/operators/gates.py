"""Ordered gate funnels: hard cuts, scores, counts before and after each gate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgauge.functions.classify import is_building, is_permissioned, sinc_major
from landgauge.operators.filters import all_of
from landgauge.operators.ranking import composite_score, many_ranks, mid_of

PTAL_LEVELS = ("0", "1a", "1b", "2", "3", "4", "5", "6a", "6b")
# Metric -> (direction, default threshold).
METRICS: dict[str, tuple[int, float | str]] = {
    "area_ha": (1, 0.1), "ptal_ai": (1, "4"), "conn_pt": (1, 80), "conn_emp": (1, 80), "conn_all": (1, 85), "z1_min": (-1, 30),
    "stn_m": (-1, 800), "resi_rent": (1, 2000), "resi_rent_2b": (1, 2000), "office_prime": (1, 50), "office_mid": (1, 40),
    "office_voa_pm2": (1, 250), "office_n": (1, 25), "price_ppm2": (1, 6000), "rent_g5": (1, 25), "rent_chg": (1, 3),
    "price_trend": (1, 0), "approval_pct": (1, 85), "plan_vs_lhn": (-1, 80), "headroom": (1, 2),
}
GATE_METRIC = {
    "ptal": "ptal_ai", "conn": "conn_pt", "z1": "z1_min", "walk": "stn_m", "resi": "resi_rent", "office": "office_prime",
    "price": "price_ppm2", "growth": "rent_g5", "headroom": "headroom",
}
KEEP_MISSING = ("office",)
LAND_TYPES = ("register", "osm_brownfield", "osm_industrial", "osm_retail", "osm_storage", "osm_parking", "green_space", "osm_leisure", "grey_belt")
GREEN_TYPES = ("green_space", "osm_leisure")
GREEN_KEPT_OUT = ("Public Park Or Garden", "Play Space", "Cemetery", "Religious Grounds", "Bowling Green", "Tennis Court")
DEFAULT_EXCLUDE = ("in_sil", "in_mol", "sinc_major", "flood3", "listed")


@dataclass(frozen=True)
class Gate:
    key: str
    mode: str = "off"
    metric: str | None = None
    value: float | str | None = None
    keep_missing: bool = False
    options: dict = field(default_factory=dict)


def gate(key: str, mode: str | None = None, metric: str | None = None, value=None, keep_missing: bool | None = None, **options) -> Gate:
    """A gate with the defaults of its kind."""
    if key in GATE_METRIC:
        metric = metric or GATE_METRIC[key]
        value = METRICS[metric][1] if value is None else value
        keep = key in KEEP_MISSING if keep_missing is None else keep_missing
        return Gate(key, mode or "off", metric, value, keep)
    base = {
        "land": {"types": [x for x in LAND_TYPES if x not in GREEN_TYPES], "green_exclude": GREEN_KEPT_OUT, "min_ha": 0.1, "exclude_building": True, "exclude_permissioned": False},
        "constraints": {"exclude": DEFAULT_EXCLUDE},
        "policy": {"require": ("in_oa",)},
        "borough": {"boroughs": ()},
    }[key]
    return Gate(key, mode or ("filter" if key == "land" else "off"), options={**base, **options})


# The four preset gate orders.
PRESETS: dict[str, list[Gate]] = {
    "balanced": [
        gate("land"), gate("ptal", "filter", value="4"), gate("z1", "filter", value=30), gate("conn", "score"), gate("resi", "score"),
        gate("office", "score", "office_voa_pm2", 250), gate("growth", "score"), gate("headroom", "score"), gate("constraints", "filter"),
        gate("walk"), gate("price"), gate("policy"), gate("borough"),
    ],
    "office": [
        gate("land", min_ha=0.1, types=list(LAND_TYPES[:6])), gate("z1", "filter", value=20), gate("ptal", "filter", value="5"),
        gate("office", "filter", "office_voa_pm2", 300, keep_missing=False), gate("conn", "score", "conn_emp", 90),
        gate("growth", "score", "approval_pct", 85), gate("constraints", "filter"), gate("resi"), gate("walk"), gate("price"),
        gate("headroom"), gate("policy"), gate("borough"),
    ],
    "btr": [
        gate("land", min_ha=0.25), gate("ptal", "filter", value="4"), gate("z1", "filter", value=35),
        gate("resi", "filter", "resi_rent_2b", 2000), gate("growth", "score", "rent_g5", 25), gate("headroom", "score"),
        gate("walk", "score"), gate("constraints", "filter"), gate("conn"), gate("office"), gate("price"), gate("policy"), gate("borough"),
    ],
    "broad": [
        gate("land", min_ha=0.25, types=list(LAND_TYPES)), gate("constraints", "filter", exclude=("in_mol", "sinc_major", "flood3")),
        gate("z1", "score"), gate("ptal", "score"), gate("conn", "score"), gate("resi", "score"), gate("growth", "score"),
        gate("office"), gate("walk"), gate("price"), gate("headroom"), gate("policy"), gate("borough"),
    ],
}


def metric_value(name: str) -> Column:
    if name == "headroom":
        return F.col("storeys_ctx") - F.coalesce("storeys_site", F.lit(0))
    return F.col(name)


def gate_constraints(exclude) -> Column:
    """True when no excluded flag is set on the row."""

    def hit(key: str) -> Column:
        if key == "listed":
            return F.coalesce("listed_n", F.lit(0)) > 0
        if key == "sinc_major":
            return sinc_major(F.col("sinc_grade"))
        if key == "sinc_any":
            return F.coalesce("sinc_grade", F.lit("")) != ""
        return F.coalesce(F.col(key), F.lit(False))

    return all_of([~hit(k) for k in exclude])


def gate_policy(require) -> Column:
    out = F.lit(not require)
    for key in require:
        out = out | F.coalesce(F.col(key), F.lit(False))
    return out


def gate_borough(boroughs) -> Column:
    return F.coalesce(F.col("borough").isin(*boroughs), F.lit(False)) if boroughs else F.lit(True)


def gate_ordinal(level: Column, at_least: str, keep_missing: bool) -> Column:
    order = F.array(*[F.lit(x) for x in PTAL_LEVELS])
    return F.when(level.isNull(), F.lit(keep_missing)).otherwise(F.array_position(order, level) > PTAL_LEVELS.index(str(at_least)))


def passes(g: Gate) -> Column:
    o = g.options
    if g.key == "land":
        conds = [F.col("src").isin(*o["types"]), F.coalesce("area_ha", F.lit(0.0)) >= o["min_ha"]]
        conds.append(~((F.col("src") == "green_space") & F.coalesce(F.col("subtype").isin(*o["green_exclude"]), F.lit(False))))
        if o["exclude_building"]:
            conds.append(~is_building(F.col("src"), F.col("subtype"), F.col("permission")))
        if o["exclude_permissioned"]:
            conds.append(~is_permissioned(F.col("src"), F.col("permission")))
        return all_of(conds)
    if g.key == "constraints":
        return gate_constraints(o["exclude"])
    if g.key == "policy":
        return gate_policy(o["require"])
    if g.key == "borough":
        return gate_borough(o["boroughs"])
    if g.metric == "ptal_ai":
        return gate_ordinal(F.col("ptal"), str(g.value), g.keep_missing)
    v = metric_value(g.metric)
    ok = v >= g.value if METRICS[g.metric][0] > 0 else v <= g.value
    return F.coalesce(ok, F.lit(g.keep_missing))


def run_gates(df: DataFrame, key: str, gates: list[Gate], stage: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(survivors with score, funnel). With `stage`, later gates neither cut nor score.

    Every row notes the first gate it fails, so the whole funnel is one grouped
    count. Percentiles are taken over the whole pool, not over the survivors.
    """
    filters = [g for g in gates if g.mode == "filter"]
    first = F
    for i, g in enumerate(filters):
        first = first.when(~F.coalesce(passes(g), F.lit(False)), F.lit(i))
    marked = df.withColumn("_failed", first.otherwise(F.lit(None).cast("int")) if filters else F.lit(None).cast("int"))
    # one row holding the count of rows lost at each gate
    lost = marked.agg(
        F.count(F.lit(1)).alias("_all"), *[F.count_if(F.col("_failed") == i).alias(f"_l{i}") for i in range(len(filters))]
    )
    steps, gone = [], F.lit(0)
    for i, g in enumerate(filters):
        before = F.col("_all") - gone
        gone = gone + F.col(f"_l{i}")
        steps.append(F.struct(F.lit(i + 1).alias("step"), F.lit(g.key).alias("gate"), before.alias("before"), (F.col("_all") - gone).alias("after")))
    funnel = lost.select(F.inline(F.array(*steps))) if steps else None
    upto = gates
    cut = F.col("_failed").isNull()
    if stage is not None:
        at = [g.key for g in gates].index(stage)
        upto = gates[: at + 1]
        n_kept = len([g for g in upto if g.mode == "filter"])
        cut = cut | (F.col("_failed") >= n_kept)
    scorers = [g for g in upto if g.mode != "off" and g.metric]
    survivors = marked.filter(cut).drop("_failed")
    if scorers:
        ranks = many_ranks(df, key, {g.key: metric_value(g.metric) for g in scorers})
        scored = ranks.select(key, composite_score([mid_of(g.key, METRICS[g.metric][0]) for g in scorers]).alias("score"))
        survivors = survivors.join(scored, key, "left").withColumn("score", F.coalesce("score", F.lit(0)))
    else:
        survivors = survivors.withColumn("score", F.lit(0))
    return survivors, funnel
