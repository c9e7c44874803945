"""Queries for the rule classifiers; each labels a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from landgauge.catalog.clean import pick, sql_pick
from landgauge.catalog.registry import query
from landgauge.functions import classify as C
from landgauge.plans import layers as LY


def q(text: str) -> str:
    return text.replace("'", "''")


@query(
    "c01_classify",
    "select o_orderkey, case when o_totalprice>400000 then 'large' when o_totalprice>150000 then 'medium' else 'small' end as size_band from orders",
)
def c01(t):
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey", C.classify([(p > 400000, "large"), (p > 150000, "medium")], "small").alias("size_band"))


OWNERS = [
    "GUY'S NHS FOUNDATION TRUST", "Ashby Town Council", "WEST MIDLANDS COMBINED AUTHORITY", "Leeds City Council",
    "University of York", "Kent Police", "SECRETARY OF STATE FOR DEFENCE", "ACME HOLDINGS LIMITED", None,
]
CATEGORIES = ["Limited Company", "Local Authority", "County Council", "Corporate Body", None, "Company", "x"]


def owner_sql(name: str, cat: str) -> str:
    whens = " ".join(f"when regexp_matches({name}, '(?i){q(rx)}') then '{label}'" for label, rx in C.OWNER_PATTERNS)
    return f"case {whens} when regexp_matches({cat}, '(?i)local authority|county council') then 'local_authority' end"


@query(
    "c02_owner_class",
    f"""with r as (select c_custkey, {sql_pick('c_custkey', OWNERS)} as n1, {sql_pick('(c_custkey//3)', OWNERS)} as n2,
  {sql_pick('c_custkey', CATEGORIES)} as k1, {sql_pick('(c_custkey//3)', CATEGORIES)} as k2 from customer)
 select c_custkey, coalesce({owner_sql('n1','k1')},{owner_sql('n2','k2')}) as owner_class from r""",
)
def c02(t):
    df = t.customer.withColumn("third", F.floor(F.col("c_custkey") / 3))
    names = [pick("c_custkey", OWNERS), pick("third", OWNERS)]
    cats = [pick("c_custkey", CATEGORIES), pick("third", CATEGORIES)]
    return df.select("c_custkey", C.classify_owner(names, cats).alias("owner_class"))


ADDRESSES = [
    "Flat 2, 19 Park Road", "Land at Park Road", "Unit 4, Mill Lane", "Unit 4, former Mill works", "12 High Street",
    "Rear of 3, flat 9, The Row", "Flats 1 - 8 Elm Court", "Apartment B - Quay House", None, "Car park, flat 2",
]


@query(
    "c03_flat_address",
    f"""with r as (select c_custkey, {sql_pick('c_custkey', ADDRESSES)} as a from customer)
 select c_custkey, coalesce(regexp_matches(a,'{q(C.FLAT_OPENING)}') or (not regexp_matches(a,'{q(C.SITE_WORDING)}') and regexp_matches(a,'{q(C.FLAT_MENTION)}')), false) as is_flat from r""",
)
def c03(t):
    return t.customer.select("c_custkey", C.is_flat_address(pick("c_custkey", ADDRESSES)).alias("is_flat"))


OWNERSHIP = ["owned-by-a-public-authority", "not-owned-by-a-public-authority", "mixed-ownership", "private", "unknown", None, "Crown", "private and mixed"]


@query(
    "c04_is_public",
    f"""with r as (select c_custkey, {sql_pick('c_custkey', OWNERSHIP)} as o from customer)
 select c_custkey, case when regexp_matches(o,'(?i)not-owned-by-a-public-authority|private|not-public') then o ilike '%mixed%'
  when regexp_matches(o,'(?i)owned-by-a-public-authority|public|crown|council|mixed') then true end as is_public from r""",
)
def c04(t):
    return t.customer.select("c_custkey", C.is_public(pick("c_custkey", OWNERSHIP)).alias("is_public"))


TAGS: list[dict[str, str]] = [
    {"landuse": "retail", "name": "Ferry Meadow"}, {"building": "retail", "name": "Corn Exchange"}, {"landuse": "commercial", "name": "Heron Business Park"},
    {"shop": "car"}, {"building": "supermarket", "building:levels": "1"}, {"landuse": "industrial"}, {"amenity": "parking"},
    {"amenity": "parking", "parking": "multi-storey"}, {"amenity": "parking", "park_ride": "yes"}, {"landuse": "garages"},
    {"man_made": "gasometer"}, {"landuse": "quarry"}, {"leisure": "golf_course"}, {"landuse": "cemetery", "building": "warehouse"},
    {"building": "warehouse", "height": "14 m"}, {"building": "warehouse", "building:levels": "2"}, {"amenity": "fuel"},
    {"building": "commercial"}, {"landuse": "retail", "name": "Weir Lane Retail & Business Park"}, {"industrial": "scrap_yard"}, {"abandoned": "yes"},
]
# the same 21 tag sets resolved by hand: (dataset, subtype) unless it depends on area and parking
LOW_VALUE_SQL = """case k when 0 then case when area>=15000 and big then 'osm_retail/retail_park' end when 1 then case when area>=1500 and near then 'osm_retail/retail' end
 when 2 then 'osm_industrial/business_park' when 3 then 'osm_retail/car' when 4 then case when area>=1500 and near then 'osm_retail/supermarket' end
 when 5 then 'osm_industrial/industrial_land' when 6 then 'osm_parking/surface' when 8 then 'osm_parking/park_and_ride' when 9 then 'osm_storage/garages'
 when 10 then 'osm_storage/gasometer' when 11 then 'osm_brownfield/quarry' when 12 then 'osm_leisure_lowdensity/golf_course'
 when 15 then 'osm_industrial/warehouse' when 16 then 'osm_retail/fuel' when 17 then case when area>=1500 and near then 'osm_industrial/commercial_shed' end
 when 18 then 'osm_retail/retail_park' when 19 then 'osm_storage/scrap_yard' end"""


@query(
    "c05_low_value_land",
    f"""with r as (select l_orderkey, l_linenumber, cast(l_partkey%21 as int) as k, l_extendedprice as area, l_quantity>20 as near, l_quantity>35 as big from lineitem)
 select label, count(*) as n, round(sum(area),2) as area_m2 from (select *, coalesce({LOW_VALUE_SQL}, 'none') as label from r) group by 1""",
)
def c05(t):
    tag_sets = t.spark.createDataFrame(list(enumerate(TAGS)), "k bigint, tags map<string,string>")
    sites = t.lineitem.withColumn("k", F.col("l_partkey") % 21).join(F.broadcast(tag_sets), "k")
    labelled = LY.label_low_value(sites, F.col("tags"), F.col("l_extendedprice"), F.col("l_quantity") > 20, F.col("l_quantity") > 35)
    return (
        labelled.withColumn("label", F.coalesce("label", F.lit("none")))
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("area_m2"))
    )


RUC = ["Urban major conurbation", "Urban city and town in a sparse setting", "Rural village (sparse)", "Larger rural: Further from a major town or city",
       "Urban: Further from a major town or city", None, None, "Some minor conurbation", "Anything rural", None]
RUC_CODES = ["A1", "C2", "E2", "RLF1", "UF1", "UN1", "C1", None, None, "Z9"]
RUC_WANT = ["urban", "suburban", "rural", "rural", "suburban", "urban", "suburban", "urban", "rural", None]


@query("c06_ruc_regime", f"select s_suppkey, {sql_pick('s_suppkey', RUC_WANT)} as regime from supplier")
def c06(t):
    return t.supplier.select("s_suppkey", C.ruc_regime(pick("s_suppkey", RUC), pick("s_suppkey", RUC_CODES)).alias("regime"))


@query(
    "c07_height_class",
    """select p_partkey, case when p_size%9=0 then 'unknown' when p_size>=25 then 'high' when p_size>=12 then 'mid' else 'low' end as height_class from part""",
)
def c07(t):
    h = F.when(F.col("p_size") % 9 != 0, F.col("p_size"))
    return t.part.select("p_partkey", C.height_class(h).alias("height_class"))


LEAGUES = ["Premier League", "Women's Premier League", "FA Cup, Premier League", "EFL League Two", "Super League", "Women's Super League", "Scottish Premiership",
           "Scottish League One", "United Rugby Championship", "RFL Championship", "National League South", None, "Cymru Premier", "Isthmian League"]
TIER_WANT = ["Premier League", "Non-league / other", "Premier League", "EFL League Two", "Super League", "Women's Super League", "Scottish Premiership",
             "Scottish lower leagues", "United Rugby Championship", "RFL Championship / League 1", "National League", None, "Cymru / NIFL Premier", None]
SPORTS = ["Cricket", "Rugby union", "Speedway", "Football", "Dog racing"]
SPORT_WANT = ["Cricket", "Rugby (other)", "Speedway", "Non-league / other", "Greyhound racing"]


@query(
    "c08_stadium_tier",
    f"""select p_partkey, case when p_partkey%14=1 then {sql_pick('(p_partkey//14)', SPORT_WANT)} else coalesce({sql_pick('p_partkey', TIER_WANT)}, {sql_pick('(p_partkey//14)', SPORT_WANT)}) end as tier from part""",
)
def c08(t):
    df = t.part.withColumn("s", F.floor(F.col("p_partkey") / 14))
    return df.select("p_partkey", C.stadium_tier(F.coalesce(pick("p_partkey", LEAGUES), F.lit("")), pick("s", SPORTS)).alias("tier"))


@query(
    "c09_stadium_typology",
    """select p_partkey, case when p_partkey%7>4 and p_size>15 then 'Sports campus'
  when p_retailprice*4000>5000000 or (p_partkey%20000>15000 and p_size*4>80) or (p_size*4>150 and p_partkey%8000>=3000) then 'City centre'
  when p_size>6 and p_partkey%30>12 and p_partkey%8000<3500 then 'Out-of-town / retail park'
  when p_partkey%8000>=5000 then 'Inner-urban neighbourhood' when p_partkey%8000>=2000 then 'Suburban' else 'Edge of town / rural' end as typology from part""",
)
def c09(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    cols = {
        "others_600": k % 7 - 4, "pitch_ha": s, "usage_1k": F.col("p_retailprice") * 4000, "jobs_800": k % 20000,
        "food_800": s * 4, "density": k % 8000, "parking_ha": s, "lowvalue_ha": k % 30,
    }
    return t.part.select("p_partkey", C.stadium_typology(cols).alias("typology"))


SPORT_TAGS = ["soccer", "Rugby_Union ", "motor", "ten_pin", "", None, "gaelic_games"]
SPORT_OUT = ["Football", "Rugby union", "Motorsport", "Ten pin", None, None, "Gaelic games"]
LABELS = ["Championship", "FA Cup", "Football League One", "League 1", "Premier League", None, "Community Shield"]
LABELS_OUT = [["RFL Championship", None, None, "RFL League 1", "Premier League", None, None],
              ["Championship", None, None, "League 1", "Premier League", None, None]]


@query(
    "c10_sport_and_league",
    f"""select p_partkey, {sql_pick('p_partkey', SPORT_OUT)} as sport, case when p_size%2=0 then {sql_pick('p_partkey', LABELS_OUT[0])} else {sql_pick('p_partkey', LABELS_OUT[1])} end as league from part""",
)
def c10(t):
    sports = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("Rugby League"))).otherwise(F.array(F.lit("Football")))
    return t.part.select(
        "p_partkey", C.sport_label(pick("p_partkey", SPORT_TAGS)).alias("sport"),
        C.clean_league(pick("p_partkey", LABELS), sports).alias("league"),
    )


@query(
    "c11_lifecycle_status",
    """select o_orderkey, case when o_orderkey%4=0 and o_orderdate<=timestamp '1998-06-01' then 'opened' when o_orderkey%4=0 then 'under construction'
  when o_orderkey%4=1 then 'under construction' else 'proposed' end as status from orders""",
)
def c11(t):
    k = F.col("o_orderkey")
    opened = F.when(k % 4 == 0, F.col("o_orderdate"))
    status = F.when(k % 4 == 1, "under construction")
    return t.orders.select("o_orderkey", C.lifecycle_status(opened, status, F.lit("1998-06-01").cast("timestamp")).alias("status"))


@query(
    "c12_station_tier_density",
    """select s_suppkey, case when s_suppkey%3=0 then 'A' when s_suppkey%2=0 then 'B' else 'ineligible' end as tier,
 case when s_suppkey%2=0 and (s_suppkey%11>=8 or s_suppkey%7>=4) then 45 when s_suppkey%2=0 then 35 when s_suppkey%3=0 then 35 end as density from supplier""",
)
def c12(t):
    k = F.col("s_suppkey")
    inset, conn = F.when(k % 3 == 0, True), F.when(k % 2 == 0, True)
    return t.supplier.select(
        "s_suppkey", C.station_tier(inset, conn).alias("tier"), C.density_floor(inset, conn, k % 11, k % 7).alias("density")
    )


@query(
    "c13_well_connected",
    """with g as (select s_nationkey, rank() over (order by sum(s_acctbal) desc, s_nationkey) as r from supplier group by 1)
 select s_suppkey, r as area_rank, s_suppkey%5<3 and r<=8 as well_connected from supplier join g using (s_nationkey)""",
)
def c13(t):
    from landgauge.operators.ranking import rank_top

    gva = t.supplier.groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("gva"))
    ranked = rank_top(gva, "gva", "s_nationkey", 8).select("s_nationkey", F.col("rank").alias("area_rank"))
    return t.supplier.join(ranked, "s_nationkey").select(
        "s_suppkey", "area_rank", C.well_connected(F.col("s_suppkey") % 5 < 3, F.col("area_rank"), 8).alias("well_connected")
    )


@query(
    "c14_cil_status",
    """with r as (select c_custkey, case when c_custkey%3=0 then 'S' else 'E' end||c_custkey as code, case when c_custkey%5=0 then null when c_custkey%5=1 then 'none' else 'adopted' end as st,
  c_custkey%2=0 as sc, c_custkey%4=0 as ad, c_acctbal as typ, case when c_custkey%7>0 then 25 end as may from customer),
 s as (select *, case when st is null and code like 'S%' then 'no_regime' when st is null and sc then 'schedule_unrated' when st is null then 'unknown'
  when st='none' and sc and ad then 'schedule_unrated' when st='none' then 'none' else st end as status from r)
 select code, status, case when status in ('no_regime','none') then 0 when status in ('schedule_unrated','unknown') then null else cast(round(typ+coalesce(may,0)) as int) end as cil_pm2 from s""",
)
def c14(t):
    k = F.col("c_custkey")
    code = F.concat(F.when(k % 3 == 0, "S").otherwise("E"), k.cast("string"))
    st = F.when(k % 5 == 1, "none").when(k % 5 > 1, "adopted")
    status = C.cil_status(code, st, k % 2 == 0, k % 4 == 0)
    return t.customer.select(
        code.alias("code"), status.alias("status"),
        C.cil_rate(status, F.col("c_acctbal"), F.when(k % 7 > 0, 25)).alias("cil_pm2"),
    )


@query(
    "c15_plan_status",
    """with p as (select case when o_orderkey%6=0 then o_custkey else o_custkey+1000000+o_orderkey%5 end as authority, year(o_orderdate) as y from orders),
 n as (select authority, count(*) as n_plans, min(y) as y from p group by 1), a as (select c_custkey as authority from customer union select authority from n)
 select authority, coalesce(n_plans,0) as n_plans, case when n_plans is null then null when n_plans>1 then 'multiple_plans' when authority%9=0 then 'joint_plan'
  when authority%4=0 and y<1998 then 'predecessor_plan' else 'compared' end as plan_status from a left join n using (authority)""",
)
def c15(t):
    """All orders are plans: one in six of the customer as authority, the others of authorities that share few plans."""
    authority = F.when(F.col("o_orderkey") % 6 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 1_000_000 + F.col("o_orderkey") % 5)
    plans = t.orders.groupBy(authority.alias("authority")).agg(F.count(F.lit(1)).alias("n_plans"), F.min(F.year("o_orderdate")).alias("y"))
    k = F.col("authority")
    joined = t.customer.select(F.col("c_custkey").alias("authority")).join(plans, "authority", "full")
    return joined.select(
        "authority", F.coalesce("n_plans", F.lit(0)).alias("n_plans"),
        C.plan_status(F.col("n_plans"), F.when(k % 9 == 0, 2).otherwise(1), F.col("y"), F.when(k % 4 == 0, 1998)).alias("plan_status"),
    )


ROADS = ["Motorway", "A Road", "B Road", "Minor Road", "Local Street", None, "Secondary", "Unclassified"]


@query("c16_half_width", "select p_partkey, case when p_size=7 then 12.0 else ([15.0,9.0,5.0,6.0,4.0,4.0,5.0,4.0])[cast(p_partkey%8 as int)+1] end::double as half_width from part")
def c16(t):
    return t.part.select("p_partkey", C.half_width(pick("p_partkey", ROADS), F.col("p_size") == 7).alias("half_width"))


PERMISSIONS = ["Full permission", "Started", "not permissioned", None, "Appeal allowed", "pemrission granted", "pending", "outline perm"]
GRADES = ["Metropolitan importance", "Borough importance grade I", "Borough importance grade II", None, "Local importance"]


@query(
    "c17_site_detectors",
    f"""with r as (select p_partkey, (['register','osm_brownfield'])[cast(p_partkey%2 as int)+1] as src, p_type, {sql_pick('(p_partkey//2)', PERMISSIONS)} as perm, {sql_pick('p_partkey', GRADES)} as g, p_size from part)
 select p_partkey, (src='osm_brownfield' and p_size%2=0) or (src='register' and coalesce(perm,'')='Started') as building,
 src='register' and coalesce(perm,'') in ('Full permission','Started','Appeal allowed','pemrission granted','outline perm') as permissioned,
 coalesce(g in ('Metropolitan importance','Borough importance grade I'), false) as sinc_major from r""",
)
def c17(t):
    df = t.part.withColumn("half", F.floor(F.col("p_partkey") / 2))
    src, perm = pick("p_partkey", ["register", "osm_brownfield"]), pick("half", PERMISSIONS)
    sub = F.when(F.col("p_size") % 2 == 0, "construction").otherwise("works")
    return df.select(
        "p_partkey", C.is_building(src, sub, perm).alias("building"), C.is_permissioned(src, perm).alias("permissioned"),
        C.sinc_major(pick("p_partkey", GRADES)).alias("sinc_major"),
    )


ZONES = ["1", "1/2", "2+3", "11", None, "3/1"]


@query("c18_zone_contains", "select s_suppkey, s_suppkey%6 in (0,1,5) as in_zone_1 from supplier")
def c18(t):
    return t.supplier.select("s_suppkey", C.zone_contains(pick("s_suppkey", ZONES), "1").alias("in_zone_1"))
