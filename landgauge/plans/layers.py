"""Layer marts: sales, public estate, registers, deprivation, usage, constraints, attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgauge.functions import classify as C
from landgauge.functions import clean as N
from landgauge.operators import aggregates as A
from landgauge.operators import linkage as L
from landgauge.operators import overlay as O
from landgauge.operators import spatial as S
from landgauge.operators.filters import BOUNDS, clean_sales, plausible, require_rows
from landgauge.operators.ranking import many_ranks, ordinal_pct, rank_top
from landgauge.session import cut_lineage


def sales_layer(sales: DataFrame, certs: DataFrame, months: int, as_of: Column) -> DataFrame:
    """Clean sales with floor area from linked certificates and a jittered point.

    `sales` sale_id, category, sold, postcode, price_text, saon, paon, street, lng, lat.
    """
    clean = clean_sales(sales, months, as_of)
    area = L.link_by_address(clean, certs, "m2", "lodged")
    ok = F.col("m2").between(*BOUNDS["m2"])
    ppm2 = F.col("price") / F.when(ok, F.col("m2"))
    dx, dy = N.hash_jitter(F.col("sale_id"))
    return (
        clean.withColumn("price", F.col("price_text").cast("bigint")).join(area, "sale_id", "left")
        .withColumn("ppm2r", F.when(ppm2.between(*BOUNDS["ppm2"]), ppm2))
        .withColumn("lng", F.col("lng") + dx).withColumn("lat", F.col("lat") + dy)
    )


def public_estate(titles: DataFrame, postcodes: DataFrame, parcels: DataFrame, cell: float, reach: float = 30.0, max_m2: float = 50_000.0) -> DataFrame:
    """Public titles grouped to points and paired with parcels.

    `titles` postcode, address, ord, names/categories arrays of equal length; `postcodes` postcode, x, y.
    """
    hits = F.transform(F.arrays_zip("names", "categories"), lambda p: C.owner_class(p["names"], p["categories"]))
    tagged = titles.withColumn("_cls", hits).withColumn("owner_class", F.get(F.filter("_cls", lambda c: c.isNotNull()), F.lit(0))).filter(F.col("owner_class").isNotNull())
    grouped = A.aggregate_titles(tagged.select("postcode", F.col("owner_class").alias("owner"), C.is_flat_address(F.col("address")).alias("is_flat"), "address", "ord"))
    points = grouped.join(postcodes, "postcode").withColumn("id", F.concat_ws("|", "postcode", "owner"))
    points = cut_lineage(points)
    paired = L.pair_parcels(points.select("id", "x", "y", "titles_land", "has_land"), parcels, cell, reach, max_m2)
    return paired.join(points.select("id", "owner", "titles_land"), "id")


BROWNFIELD_COLUMNS = {
    "reference": ["reference", "sitereference", "site reference"],
    "name": ["sitenameaddress", "name", "site name"],
    "hectares": ["hectares", "site area"],
    "ownership": ["ownershipstatus", "ownership status"],
    "min_dwellings": ["minnetdwellings", "minimum-net-dwellings"],
    "max_dwellings": ["netdwellingsrangeto", "maximum-net-dwellings"],
    "permission_date": ["permissiondate", "planning-permission-date"],
    "point": ["point", "geom"],
}


def brownfield_register(raw: DataFrame, parcels: DataFrame, cell: float) -> DataFrame:
    """Messy register rows to typed ones, each with the smallest parcel that holds it."""
    r = N.resolve_columns(raw, BROWNFIELD_COLUMNS, contains=True, required=("reference",))
    x, y = N.parse_point_text(F.col("point"))
    typed = r.select(
        "reference", N.tidy_text(F.col("name"), 160).alias("name"), N.parse_number(F.col("hectares"), positive=True).alias("hectares"), C.is_public(F.col("ownership")).alias("is_public"),
        N.parse_number(F.col("min_dwellings")).cast("int").alias("min_dwellings"), N.parse_number(F.col("max_dwellings")).cast("int").alias("max_dwellings"),
        N.parse_iso_date(F.col("permission_date")).alias("permission_date"), x.alias("x"), y.alias("y"),
    ).dropDuplicates(["reference"])
    typed = cut_lineage(typed)
    inside = S.points_in_polygons(typed.filter(F.col("x").isNotNull()), "reference", parcels, "parcel_id", cell, cols=["area"])
    held = S.containing_area(inside, "reference", parcels, "parcel_id", [], "area").select("reference", "parcel_id")
    return typed.join(held, "reference", "left")


def deprivation_layer(scores: DataFrame, key: str, domains: Sequence[str], people: DataFrame) -> DataFrame:
    """Average-rank percentile (1 dp) of every domain, with population where it is known."""
    ranks = many_ranks(scores, key, {d: F.col(d) for d in domains})
    pct = [F.round((F.col(f"{d}_below") + (F.col(f"{d}_at") + 1) / 2) / F.col(f"{d}_total") * 100, 1).alias(f"{d}_pct") for d in domains]
    return L.join_area(ranks.select(key, *pct), people, key, ["population"])


def station_usage(stations: DataFrame, usage: DataFrame, latest: int) -> DataFrame:
    """Usage by id, else by name, with the trend, season share and ordinal percentile.

    `stations` id, nm; `usage` id, nm, year, entries, season.
    """
    trend = usage.groupBy("id", "nm").agg(
        F.sort_array(F.collect_list(F.struct("year", "entries"))).alias("trend"),
        F.max(F.when(F.col("year") == latest, F.col("entries"))).alias("entries"),
        F.max(F.when(F.col("year") == latest, F.col("season"))).alias("season"),
    )
    joined = cut_lineage(L.id_or_name(stations, trend, "id", "nm", ["trend", "entries", "season"]))
    pct = ordinal_pct(joined.filter("entries is not null").select("key", "entries"), "entries", "key", "usage_pctile").select("key", "usage_pctile")
    return joined.join(pct, "key", "left").withColumn("season_share", F.round(F.col("season") / F.nullif(F.col("entries"), F.lit(0.0)), 3))


def tag_stations(stations: DataFrame, areas: DataFrame, gva: DataFrame, ruc: DataFrame, cell: float, top: int = C.TOP_AREAS) -> DataFrame:
    """Travel area, its rank by output, density regime and the well-connected test."""
    inside = S.points_in_polygons(stations, "sid", areas, "area_id", cell, ("sx", "sy"))
    ranked = rank_top(gva, "gva", "area_id", top).select("area_id", F.col("rank").alias("area_rank"))
    tagged = stations.join(inside, "sid", "left").join(ranked, "area_id", "left").join(ruc, "area_id", "left")
    return tagged.withColumn("regime", C.ruc_regime(F.col("ruc_name"), F.col("ruc_code"))).withColumn("well_connected", C.well_connected(F.col("meets_frequency"), F.col("area_rank"), top))


def transport_constraint(lines: DataFrame) -> DataFrame:
    """kind, line_id, cls, half_width, rings: what lies within each class's half width of road and rail centre lines.

    `lines` line_id, cls, is_rail, x1, y1, x2, y2. Shapes of one line overlap; overlay.union counts that once.
    """
    point = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    drawn = lines.select("line_id", "cls", C.half_width(F.col("cls"), F.col("is_rail")).cast("double").alias("half_width"), F.array(F.array(point("x1", "y1"), point("x2", "y2"))).alias("rings"))
    return O.standoff(drawn, ["line_id", "cls", "half_width"], F.col("half_width")).withColumn("kind", F.lit("transport"))


def planning_layer(areas: DataFrame, rents: DataFrame, rates: DataFrame, stock: DataFrame, ratio: DataFrame) -> DataFrame:
    """Rents (re-keyed by unique name), charge status and housing need per district.

    `areas` code, nm; `rents` code, nm, rent; `rates` nm, rate_status, typical, mayoral, scheduled, adopted;
    `stock` code, stock; `ratio` code, ratio.
    """
    moved = L.rekey_by_name(rents, areas, "code", "nm").select(F.col("new_code").alias("code"), "rent")
    one = rates.groupBy("nm").agg(F.min(F.struct("rate_status", "typical", "mayoral", "scheduled", "adopted")).alias("_r")).select("nm", "_r.*")
    joined = areas.join(moved, "code", "left").join(one, "nm", "left").join(stock, "code", "left").join(ratio, "code", "left")
    status = C.cil_status(F.col("code"), F.col("rate_status"), F.col("scheduled"), F.col("adopted"))
    factor, need = A.housing_need(F.col("stock"), F.col("ratio"))
    return joined.withColumn("cil_status", status).select(
        "code", "rent", "cil_status", C.cil_rate(F.col("cil_status"), F.col("typical"), F.col("mayoral")).alias("cil_pm2"),
        F.round(factor, 3).alias("factor"), F.round(need).cast("bigint").alias("lhn"),
        F.when(F.col("stock").isNull() | F.col("ratio").isNull(), "no_data").otherwise("ok").alias("status"),
    )


def energy_layer(substations: DataFrame, queue: DataFrame, areas: DataFrame, cell: float) -> tuple[DataFrame, DataFrame]:
    """(queue rows placed on substations by name, megawatts waiting per area).

    `substations` sub_id, name, volts, x, y; `queue` q_id, site, mw.
    """
    subs = substations.select("sub_id", N.norm_name(F.col("name"), "gridsite").alias("sn"), N.parse_kv(F.col("volts")).alias("kv"), "x", "y")
    placed = L.contains_match(queue.withColumn("qn", N.norm_name(F.col("site"), "gridsite")), "q_id", "qn", subs, "sub_id", "sn")
    placed = placed.join(subs.select("sub_id", "kv", "x", "y"), "sub_id", "left").select("q_id", "mw", "sub_id", "kv", "x", "y")
    inside = S.points_in_polygons(subs, "sub_id", areas, "area_id", cell)
    totals = placed.join(inside, "sub_id").groupBy("area_id").agg(F.sum("mw").alias("mw"), F.count(F.lit(1)).alias("n"))
    return placed, totals


def buildings_layer(df: DataFrame, tags: str, key: str) -> DataFrame:
    """Height, storeys and class from raw tag text."""
    h, s = N.height_storeys(N.parse_height(N.hstore_get(F.col(tags), "height")), N.parse_levels(N.hstore_get(F.col(tags), "building:levels")))
    return df.select(key, h.alias("height_m"), s.alias("storeys")).withColumn("height_class", C.height_class(F.col("height_m")))


def label_low_value(df: DataFrame, tags: Column, area: Column, near: Column, big: Column) -> DataFrame:
    """Adds label, C.classify_low_value of every row; the rules run once per different set of the tags they look at."""
    told = F.map_filter(F.coalesce(tags, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*C.LOW_VALUE_KEYS) & v.isNotNull())
    keyed = df.withColumn("_set", F.array_sort(F.map_entries(told)))
    # of a site's size and parking only two answers matter, so a set has four cases
    cases = keyed.select("_set").distinct().select("_set", F.map_from_entries("_set").alias("_tags"), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("_case"))
    facts = C.low_value_facts(F.col("_tags"), F.col("_case") % 2 == 1, F.col("_case") >= 2)
    known = cut_lineage(cases.withColumns({f"_{name}": fact for name, fact in facts.items()}))
    labelled = known.select("_set", "_case", C.low_value_label(F.col("_tags"), {name: F.col(f"_{name}") for name in facts}).alias("label"))
    case = C.is_shed(area, near).cast("int") + 2 * C.is_district(area, big).cast("int")
    return keyed.withColumn("_case", case).join(cut_lineage(labelled), ["_set", "_case"]).drop("_set", "_case")


def low_value_layer(features: DataFrame, parking: DataFrame) -> DataFrame:
    """id, dataset, subtype, area of low-value land. `features` id, tags, area, x, y; `parking` x, y, area."""
    big_enough = features.filter(F.col("area") >= C.MIN_SITE_M2)
    lots = parking.select(F.col("x").alias("cx0"), F.col("y").alias("cy0"), F.col("area").alias("lot"))
    near = S.has_within(big_enough, lots.filter(F.col("lot") >= C.SHED_PARKING_M2), C.SHED_PARKING_R, "id", ("x", "y"), ("cx0", "cy0")).withColumn("near", F.lit(True))
    big = S.has_within(big_enough, lots.filter(F.col("lot") >= C.DISTRICT_PARKING_M2), C.DISTRICT_PARKING_R, "id", ("x", "y"), ("cx0", "cy0")).withColumn("big", F.lit(True))
    flagged = big_enough.join(near, "id", "left").join(big, "id", "left").na.fill(False, ["near", "big"])
    parts = F.split("label", "/")
    return label_low_value(flagged, F.col("tags"), F.col("area"), F.col("near"), F.col("big")).filter(F.col("label").isNotNull()).select("id", parts[0].alias("dataset"), parts[1].alias("subtype"), "area")


def office_values(lines: DataFrame, postcodes: DataFrame, min_rows: int) -> DataFrame:
    """Rated offices with a plausible rate and floor area, at a jittered postcode point."""
    ok = plausible(lines, {"rate_pm2": BOUNDS["rate_pm2"]}).filter(F.col("m2") >= BOUNDS["m2"][0])
    dx, dy = N.hash_jitter(F.col("uarn"))
    placed = require_rows(ok, min_rows, "offices").join(postcodes, "postcode")
    return placed.withColumn("lng", F.col("lng") + dx).withColumn("lat", F.col("lat") + dy)

