"""Queries for spatial and linkage joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from landgauge.catalog import bindings as B
from landgauge.catalog.geometry import BLOCK_CELLS_SQL, CELL, MOVED_SQL, block_pieces, moved, rings, site_pieces
from landgauge.catalog.registry import query
from landgauge.functions.clean import norm_name
from landgauge.operators import cells as K
from landgauge.operators import linkage as L
from landgauge.operators import spatial as S

SA = B.ctes(B.STATIONS_SQL, B.AMENITIES_SQL)
D = "sqrt(pow(sx-x,2)+pow(sy-y,2))"
BIG = 5000.0


@query(
    "j01_join_area",
    "select c_custkey, c_nationkey as area, r_name as region, case when r_name is null then 'no_data' else 'ok' end as status from customer left join (select n_nationkey, r_name from nation join region on r_regionkey=n_regionkey where n_nationkey%4>0) on n_nationkey=c_nationkey",
)
def j01(t):
    facts = t.nation.filter("n_nationkey % 4 > 0").join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("area"), F.col("r_name").alias("region"))
    return L.join_area(t.customer.select("c_custkey", F.col("c_nationkey").alias("area")), facts, "area", ["region"])


@query("j02_points_in_polygons", B.ctes(B.AMENITIES_SQL, B.SITES_SQL) + "select id, site_id from amenities join sites on x>=minx and x<maxx and y>=miny and y<maxy")
def j02(t):
    return S.points_in_polygons(B.amenities(t), "id", rings(B.sites(t), "site_id"), "site_id", 250.0)


@query(
    "j03_polygons_intersect",
    B.ctes(B.BLOCKS_SQL, B.SITES_SQL, MOVED_SQL) + "select site_id, block_id from moved s join blocks b on s.minx<b.maxx and b.minx<s.maxx and s.miny<b.maxy and b.miny<s.maxy",
)
def j03(t):
    """Sites lie across the grid, so many pairs share a cell and no area."""
    return S.polygons_intersect(site_pieces(t), "site_id", block_pieces(t, "block_id"), "block_id", 250.0)


@query("j04_within_distance", SA + f"select sid, id, round({D},4) as dist from stations, amenities where {D}<=3000")
def j04(t):
    return S.within_distance(B.stations(t), B.amenities(t), 3000.0).select("sid", "id", F.round("dist", 4).alias("dist"))


@query(
    "j05_nearest",
    SA + f"select id, sid, round({D},4) as dist, cast(least(round({D}/100),255) as int) as units from amenities, stations where {D}<=25000 qualify row_number() over (partition by id order by {D}, sid)=1",
)
def j05(t):
    near = S.nearest(B.amenities(t), "id", B.stations(t), "sid", 25000.0, 1, ("x", "y"), ("sx", "sy"))
    return near.select("id", "sid", F.round("dist", 4).alias("dist"), S.distance_units(F.col("dist")).alias("units"))


@query(
    "j06_best_of_nearest",
    SA + f""", k as (select id, sid, {D} as d, s_acctbal/100 as cost from amenities, stations where {D}<=30000 qualify row_number() over (partition by id order by {D}, sid)<=8)
 select id, sid, round(d,4) as dist, round(cost+d*1.25/80,4) as minutes from k qualify row_number() over (partition by id order by cost+d*1.25/80, sid)=1""",
)
def j06(t):
    st = B.stations(t).withColumn("cost", F.col("s_acctbal") / 100)
    best = S.best_of_nearest(B.amenities(t), "id", st, "sid", "cost", 30000.0, 8, a_xy=("x", "y"), b_xy=("sx", "sy"))
    return best.select("id", "sid", F.round("dist", 4).alias("dist"), F.round("minutes", 4).alias("minutes"))


@query(
    "j07_adaptive_radius",
    SA + f""", c as (select sid, count(*) filter (where {D}<=2000) a, count(*) filter (where {D}<=5000) b, count(*) filter (where {D}<=10000) c, count(*) filter (where {D}<=25000) d from stations, amenities group by 1)
 select sid, case when a>=5 then 2000 when b>=5 then 5000 when c>=5 then 10000 else 25000 end::double as radius, case when a>=5 then a when b>=5 then b when c>=5 then c else d end as n from c""",
)
def j07(t):
    out = S.adaptive_radius(B.stations(t), "sid", B.amenities(t), [2000, 5000, 10000, 25000], 5)
    return out.select("sid", "radius", "n")


@query(
    "j08_catchment_or_nearest",
    SA + f""", c as (select sid, avg(c_acctbal) filter (where {D}<=1500) as cat from stations, amenities group by 1),
 n as (select sid, c_acctbal as near from stations, amenities where {D}<=30000 qualify row_number() over (partition by sid order by {D}, id)=1)
 select sid, round(coalesce(cat, near),4) as value, cat is null as from_nearest from c left join n using (sid)""",
)
def j08(t):
    st, am = B.stations(t), B.amenities(t)
    cat = S.catchment_totals(st, "sid", am, [1500], {"n": F.lit(1), "v": F.col("c_acctbal")}).select("sid", F.when(F.col("n_1500") > 0, F.col("v_1500") / F.col("n_1500")).alias("cat"))
    near = S.nearest(st, "sid", am, "id", 30000.0, cols=["c_acctbal"]).select("sid", F.col("c_acctbal").alias("near"))
    return cat.join(near, "sid", "left").select("sid", F.round(F.coalesce("cat", "near"), 4).alias("value"), F.col("cat").isNull().alias("from_nearest"))


@query(
    "j09_layer_flags",
    B.ctes(B.BLOCKS_SQL, B.SITES_SQL, MOVED_SQL)
    + """select site_id, coalesce(bool_or(kind='built_land'),false) as built, coalesce(bool_or(kind='sssi'),false) as sssi, coalesce(bool_or(kind='green_belt'),false) as green_belt
 from moved s left join blocks b on s.minx<b.maxx and b.minx<s.maxx and s.miny<b.maxy and b.miny<s.maxy group by 1""",
)
def j09(t):
    hits = S.polygons_intersect(site_pieces(t), "site_id", block_pieces(t, "kind", "block_id"), "kind", 250.0)
    names = {"built": "built_land", "sssi": "sssi", "green_belt": "green_belt"}
    flags = hits.groupBy("site_id").agg(*[F.bool_or(F.col("kind") == k).alias(n) for n, k in names.items()])
    return B.sites(t).select("site_id").join(flags, "site_id", "left").select("site_id", *[F.coalesce(n, F.lit(False)).alias(n) for n in names])


@query(
    "j10_covers_site",
    B.ctes(B.BLOCKS_SQL, B.SITES_SQL, MOVED_SQL)
    + """, o as (select site_id, block_id, greatest(0,least(s.maxx,b.maxx)-greatest(s.minx,b.minx))*greatest(0,least(s.maxy,b.maxy)-greatest(s.miny,b.miny))/((s.maxx-s.minx)*(s.maxy-s.miny)) as share,
  (s.minx+s.maxx)/2>=b.minx and (s.minx+s.maxx)/2<b.maxx and (s.miny+s.maxy)/2>=b.miny and (s.miny+s.maxy)/2<b.maxy as inside from moved s, blocks b)
 select site_id, block_id from o where inside or share>=0.1""",
)
def j10(t):
    sites = moved(B.sites(t)).withColumn("x", (F.col("minx") + F.col("maxx")) / 2).withColumn("y", (F.col("miny") + F.col("maxy")) / 2)
    inside = S.points_in_polygons(sites, "site_id", rings(B.blocks(t), "block_id"), "block_id", CELL)
    return S.covers_site(site_pieces(t), "site_id", block_pieces(t, "block_id"), "block_id", 250.0, inside)


@query(
    "j11_containing_area",
    B.ctes(B.AMENITIES_SQL, B.SITES_SQL) + "select id, p_type as dataset, site_id, (maxx-minx)*(maxy-miny) as m2 from amenities join sites on x>=minx and x<maxx and y>=miny and y<maxy qualify row_number() over (partition by id, p_type order by (maxx-minx)*(maxy-miny), site_id)=1",
)
def j11(t):
    sites = rings(B.sites(t), "site_id").withColumn("m2", (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))).withColumn("dataset", F.col("p_type"))
    inside = S.points_in_polygons(B.amenities(t), "id", sites, "site_id", 250.0, cols=["dataset", "m2"])
    return S.containing_area(inside, "id", sites, "site_id", ["dataset"], "m2").select("id", "dataset", "site_id", "m2")


@query(
    "j12_area_weighted",
    B.ctes(B.BLOCKS_SQL, B.SITES_SQL, MOVED_SQL)
    + """, o as (select block_id, greatest(0,least(s.maxx,b.maxx)-greatest(s.minx,b.minx))*greatest(0,least(s.maxy,b.maxy)-greatest(s.miny,b.miny))/((s.maxx-s.minx)*(s.maxy-s.miny)) as share, p_size as pop, case when site_id%3>0 then p_retailprice end as imd from moved s join blocks b on s.minx<b.maxx and b.minx<s.maxx and s.miny<b.maxy and b.miny<s.maxy)
 select block_id, round(sum(pop*share),6) as pop, round(sum(pop*share*imd)/nullif(sum(pop*share) filter (where imd is not null),0),6) as imd from o group by 1""",
)
def j12(t):
    facts = B.sites(t).select("site_id", F.col("p_size").alias("pop"), F.when(F.col("site_id") % 3 > 0, F.col("p_retailprice")).alias("imd"))
    out = S.area_weighted(block_pieces(t, "block_id"), "block_id", site_pieces(t), "site_id", 250.0, facts, "pop", ["imd"])
    return out.select("block_id", F.round("pop", 6).alias("pop"), F.round("imd", 6).alias("imd"))


@query(
    "j13_spatial_or_name",
    B.ctes(B.AREAS_SQL, B.AMENITIES_SQL)
    + """, a as (select id, case when id%3>0 then x end as x, case when id%3>0 then y end as y, 'city of nation_'||(id%30) as nm from amenities),
 s as (select id, area_id from a join areas on x>=minx and x<maxx and y>=miny and y<maxy)
 select a.id, coalesce(s.area_id, n.area_id) as area_id, case when s.area_id is not null then 'spatial' when n.area_id is not null then 'name' end as how
 from a left join s using (id) left join areas n on lower(n.area_name)=replace(a.nm,'city of ','')""",
)
def j13(t):
    apps = B.amenities(t).select("id", "x", "y", F.concat(F.lit("City of NATION_"), (F.col("id") % 30).cast("string")).alias("nm"))
    apps = apps.withColumn("x", F.when(F.col("id") % 3 > 0, F.col("x"))).withColumn("y", F.when(F.col("id") % 3 > 0, F.col("y")))
    areas = B.areas(t)
    inside = S.points_in_polygons(apps.filter("x is not null"), "id", rings(areas, "area_id"), "area_id", BIG).withColumnRenamed("area_id", "s_area")
    names = areas.select(norm_name(F.col("area_name"), "authority").alias("nm"), F.col("area_id").alias("n_area"))
    out = apps.withColumn("nm", norm_name(F.col("nm"), "authority")).join(inside, "id", "left").join(names, "nm", "left")
    how = F.when(F.col("s_area").isNotNull(), "spatial").when(F.col("n_area").isNotNull(), "name")
    return out.select("id", F.coalesce("s_area", "n_area").alias("area_id"), how.alias("how"))


@query(
    "j14_rekey_by_name",
    "select (case when c_custkey%2=0 then 'E' else 'W' end)||c_custkey as code, (case when c_custkey%2=0 then 'E' else 'W' end)||c_custkey||(case when c_custkey%5=0 then 'x' else '' end) as new_code from customer",
)
def j14(t):
    k = F.col("c_custkey")
    letter = F.when(k % 2 == 0, "E").otherwise("W")
    a = t.customer.select(F.concat(letter, k.cast("string")).alias("code"), norm_name(F.col("c_name")).alias("nm"))
    b = t.customer.select(F.concat(letter, k.cast("string"), F.when(k % 5 == 0, "x").otherwise("")).alias("code"), norm_name(F.col("c_name")).alias("nm"))
    return L.rekey_by_name(a, b, "code", "nm").select("code", "new_code")


@query(
    "j15_contains_match",
    """with p as (select p_partkey, regexp_replace(p_name,'[^a-z0-9]','','g') as nm from part), s as (select distinct regexp_replace(p_name,'[^a-z0-9]','','g') as sn from part)
 select p_partkey, s.sn as substation from p left join s on length(sn)>=4 and (contains(nm,sn) or contains(sn,nm)) qualify row_number() over (partition by p_partkey order by length(sn) desc, sn)=1""",
)
def j15(t):
    a = t.part.select("p_partkey", norm_name(F.col("p_name")).alias("nm"))
    b = t.part.select(norm_name(F.col("p_name")).alias("sn")).distinct()
    return L.contains_match(a, "p_partkey", "nm", b.withColumn("substation", F.col("sn")), "substation", "sn").select("p_partkey", "substation")


@query(
    "j16_id_or_name",
    """with a as (select case when c_custkey%4=0 then null else c_custkey end as id, c_custkey as k, lower(c_name) as nm from customer), b as (select c_custkey as id, lower(c_name) as nm, c_acctbal as usage from customer where c_custkey%5>0)
 select k, case when b1.id is not null then b1.usage else b2.usage end as usage, case when b1.id is not null then 'id' when b2.id is not null then 'name' else 'unmatched' end as matched_by from a left join b b1 on a.id=b1.id left join b b2 on a.nm=b2.nm""",
)
def j16(t):
    k = F.col("c_custkey")
    a = t.customer.select(F.when(k % 4 > 0, k).alias("id"), k.alias("k"), norm_name(F.col("c_name"), "station").alias("nm"))
    b = t.customer.filter(k % 5 > 0).select(k.alias("id"), norm_name(F.col("c_name"), "station").alias("nm"), F.col("c_acctbal").alias("usage"))
    return L.id_or_name(a, b, "id", "nm", ["usage"]).select("k", "usage", "matched_by")


@query(
    "j17_link_by_address",
    """with sl as (select o_orderkey as sale_id, o_custkey%500 as pc, case when o_orderkey%3=0 then 'FLAT'||(o_orderkey%5) end as saon, cast(o_orderkey%20 as varchar) as paon, 'HIGHST' as street from orders),
 ce as (select o_orderkey as cert_id, o_custkey%500 as pc, case when o_orderkey%3=1 then 'FLAT'||(o_orderkey%5) end as saon, cast(o_orderkey%20 as varchar) as paon, case when o_orderkey%2=0 then 'HIGHST' else '' end as street, o_totalprice as m2, o_orderdate as lodged from orders),
 sk as (select sale_id, pc, 0 as rk, case when saon is not null then saon||paon||street else paon||street end as k from sl union all select sale_id, pc, 1, case when saon is not null then saon||paon else paon end from sl),
 ck as (select *, case when saon is not null then saon||paon||street else paon||street end as k from ce qualify row_number() over (partition by pc, k order by lodged desc, cert_id desc)=1)
 select sale_id, cert_id, m2 from sk join ck using (pc, k) qualify row_number() over (partition by sale_id order by rk)=1""",
)
def j17(t):
    k = F.col("o_orderkey")
    pc, paon = (F.col("o_custkey") % 500).alias("postcode"), (k % 20).cast("string").alias("paon")
    flat = F.concat(F.lit("Flat "), (k % 5).cast("string"))
    sales = t.orders.select(k.alias("sale_id"), pc, F.when(k % 3 == 0, flat).alias("saon"), paon, F.lit("High St").alias("street"))
    certs = t.orders.select(k.alias("cert_id"), pc, F.when(k % 3 == 1, flat).alias("saon"), paon, F.when(k % 2 == 0, "HIGH ST.").otherwise("").alias("street"), F.col("o_totalprice").alias("m2"), F.col("o_orderdate").alias("lodged"))
    return L.link_by_address(sales, certs, "m2", "lodged")


def owner_points(t):
    am = B.amenities(t)
    return am.select("id", "x", "y", F.abs("c_acctbal").cast("int").alias("titles_land"), (F.col("id") % 4 > 0).alias("has_land"))


def parcels(t):
    s = rings(B.sites(t), "site_id")
    return s.select(F.col("site_id").alias("parcel_id"), "rings", "minx", "miny", "maxx", "maxy", ((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))).alias("area"), (F.col("minx") - 15).alias("px"), F.col("miny").alias("py"))


@query(
    "j18_pair_parcels",
    B.ctes(B.AMENITIES_SQL, B.SITES_SQL)
    + """, a as (select id, x, y, cast(abs(c_acctbal) as int) as tl from amenities where id%4>0), ins as (select site_id, id, trunc(abs((select c_acctbal from amenities z where z.id=a.id))) as tl from a join sites on x>=minx and x<maxx and y>=miny and y<maxy),
 held as (select site_id, id from ins qualify row_number() over (partition by site_id order by tl desc, id)=1),
 stray as (select * from a where id not in (select id from ins)), small as (select site_id, minx-15 as px, miny as py from sites where (maxx-minx)*(maxy-miny)<=360000 and site_id not in (select site_id from held)),
 near as (select id, site_id, sqrt(pow(x-px,2)+pow(y-py,2)) as d from stray, small where sqrt(pow(x-px,2)+pow(y-py,2))<=800 qualify row_number() over (partition by id order by d, site_id)=1)
 select site_id as parcel_id, id, 'contains' as match, null::double as match_dist_m from held union all
 select site_id, id, 'nearest', round(d,4) from near qualify row_number() over (partition by site_id order by d, id)=1""",
)
def j18(t):
    out = L.pair_parcels(owner_points(t), parcels(t), 250.0, 800.0, 360_000.0)
    return out.withColumn("match_dist_m", F.round("match_dist_m", 4)).select("parcel_id", "id", "match", "match_dist_m")


@query(
    "j19_match_register",
    B.ctes(B.AMENITIES_SQL, B.SITES_SQL)
    + """, raw as (select case when o_orderkey%3>0 then o_custkey end as uprn, o_custkey, o_totalprice as m2 from orders),
 h as (select coalesce(cast(uprn as varchar), 'c'||o_custkey) as holding, min(o_custkey) as ck, max(m2) as m2 from raw group by 1),
 p as (select holding, m2, x, y from h join amenities on id=ck)
 select site_id as parcel_id, count(*) as n_holdings, round(sum(m2),2) as stated_m2, round(sum(m2)/((maxx-minx)*(maxy-miny)),6) as ratio, not (sum(m2)/((maxx-minx)*(maxy-miny)) between 0.2 and 5) as mismatch
 from p join sites on x>=minx and x<maxx and y>=miny and y<maxy group by site_id, minx, miny, maxx, maxy""",
)
def j19(t):
    cust = B.amenities(t).select(F.col("id").alias("uprn"), "x", "y")
    assets = t.orders.select(F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("uprn"), B.px(F.col("o_custkey")).alias("x"), B.py(F.col("o_custkey")).alias("y"), F.col("o_totalprice").alias("stated_m2"))
    out = L.match_register(assets, cust, parcels(t), 250.0)
    return out.select("parcel_id", "n_holdings", F.round("stated_m2", 2).alias("stated_m2"), F.round("ratio", 6).alias("ratio"), "mismatch")


@query(
    "j20_smallest_parcel",
    B.ctes(B.AMENITIES_SQL, B.SITES_SQL) + "select id, site_id as parcel_id from amenities join sites on x>=minx and x<maxx and y>=miny and y<maxy qualify row_number() over (partition by id order by (maxx-minx)*(maxy-miny), site_id)=1",
)
def j20(t):
    inside = S.points_in_polygons(B.amenities(t), "id", parcels(t), "parcel_id", 250.0, cols=["area"])
    return S.containing_area(inside, "id", parcels(t), "parcel_id", [], "area").select("id", "parcel_id")


@query(
    "j21_keyed_nearest",
    B.ctes(B.VENUES_SQL, B.AMENITIES_SQL)
    + """select v.id as link_id, a.id as point_id, round(sqrt(pow(v.x-a.x,2)+pow(v.y-a.y,2)),4) as dist from venues v join amenities a on v.id%10=a.id%10 and sqrt(pow(v.x-a.x,2)+pow(v.y-a.y,2))<=case v.id%3 when 0 then 4000 when 1 then 3000 else 1500 end qualify row_number() over (partition by v.id order by sqrt(pow(v.x-a.x,2)+pow(v.y-a.y,2)), a.id)=1""",
)
def j21(t):
    links = B.venues(t).select(F.col("id").alias("link_id"), (F.col("id") % 10).alias("road"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    pts = B.amenities(t).select(F.col("id").alias("point_id"), (F.col("id") % 10).alias("road"), "x", "y")
    cls = F.col("link_id") % 3
    reach = F.when(cls == 0, 4000.0).when(cls == 1, 3000.0).otherwise(1500.0)
    return L.keyed_nearest(links, pts, "link_id", "point_id", "road", reach).withColumn("dist", F.round("dist", 4))


@query(
    "j22_dedupe_near",
    B.ctes(B.AMENITIES_SQL) + """, a as (select *, id%3 as prio from amenities)
 select id from a where not exists (select 1 from a b where b.id<>a.id and sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))<=1500 and (b.prio<a.prio or (b.prio=a.prio and b.id<a.id)))""",
)
def j22(t):
    return L.dedupe_near(B.amenities(t).withColumn("prio", F.col("id") % 3), 1500.0, "id", "prio").select("id")


@query(
    "j23_drop_covered",
    B.ctes(B.AMENITIES_SQL, B.SITES_SQL) + "select id from amenities where not exists (select 1 from sites where x>=minx and x<maxx and y>=miny and y<maxy)",
)
def j23(t):
    return L.drop_covered(B.amenities(t), "id", rings(B.sites(t), "site_id"), "site_id", 250.0).select("id")


@query(
    "j24_merge_nearby",
    B.ctes(B.VENUES_SQL, B.AMENITIES_SQL)
    + """, a as (select p_partkey as id, p_name as name, x, y from venues join part on id=p_partkey), b as (select id, (['small ring','red bolt','blue gear','green valve','big widget'])[cast(id%5 as int)+1] as name, x, y, case when id%2=0 then 'opened' else 'proposed' end as status from amenities),
 w as (select b.id as bid, min(a.id) as id from a join b on sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))<=2500 and len(list_intersect(regexp_extract_all(a.name,'[a-z]{4,}'), regexp_extract_all(b.name,'[a-z]{4,}')))>0 or (sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))<=2500 and (len(regexp_extract_all(a.name,'[a-z]{4,}'))=0 or len(regexp_extract_all(b.name,'[a-z]{4,}'))=0)) group by 1),
 j as (select w.id, bool_or(b.status='opened') as op, count(distinct bid%7) as nt from w join b on b.id=bid group by 1)
 select a.id, coalesce(case when op then 'opened' end,'proposed') as status, case when j.id is null then 'a' else 'both' end as source, coalesce(nt,0)+1 as n_tags from a left join j using (id)
 union all select id, status, 'b', 1 from b where id not in (select bid from w)""",
)
def j24(t):
    a = B.points(t.part, "p_partkey", F.col("p_name").alias("name")).select("id", "name", "x", "y", F.lit("proposed").alias("status"), F.lit(None).cast("string").alias("opened"), F.array(F.lit("a")).alias("tags"))
    names = F.element_at(F.array(*[F.lit(n) for n in ("small ring", "red bolt", "blue gear", "green valve", "big widget")]), (F.col("id") % 5 + 1).cast("int"))
    b = B.amenities(t).select("id", names.alias("name"), "x", "y", F.when(F.col("id") % 2 == 0, "opened").otherwise("proposed").alias("status"), F.lit("2024-01-01").alias("opened"), F.array((F.col("id") % 7).cast("string")).alias("tags"))
    return L.merge_nearby(a, b, 2500.0).select("id", "status", "source", F.size("tags").cast("bigint").alias("n_tags"))


@query(
    "j25_supplement",
    B.ctes(B.BLOCKS_SQL, B.SITES_SQL, BLOCK_CELLS_SQL, MOVED_SQL)
    + """, c as (select distinct cx*100.0 as x, cy*100.0 as y from block_cells),
 o as (select site_id, sum((least(maxx,x+100)-greatest(minx,x))*(least(maxy,y+100)-greatest(miny,y))) as m2 from moved join c on x<maxx and x+100>minx and y<maxy and y+100>miny group by 1)
 select site_id from moved left join o using (site_id) where coalesce(m2,0)<0.5*(maxx-minx)*(maxy-miny)""",
)
def j25(t):
    """Candidate sites less than half covered by existing blocks, whose overlaps count once, are inserted."""
    return S.supplement(site_pieces(t), "site_id", block_pieces(t), 250.0)


@query(
    "j26_near_sized",
    B.ctes(B.VENUES_SQL, B.AMENITIES_SQL)
    + """select id, exists(select 1 from venues v where v.p_size*100>=1000 and sqrt(pow(v.x-a.x,2)+pow(v.y-a.y,2))<=700) as near, exists(select 1 from venues v where v.p_size*100>=4000 and sqrt(pow(v.x-a.x,2)+pow(v.y-a.y,2))<=1500) as big from amenities a""",
)
def j26(t):
    am, cp = B.amenities(t), B.venues(t).select(F.col("x").alias("vx"), F.col("y").alias("vy"), (F.col("p_size") * 100).alias("m2"))
    near = S.has_within(am, cp.filter("m2 >= 1000"), 700.0, "id", ("x", "y"), ("vx", "vy")).withColumn("near", F.lit(True))
    big = S.has_within(am, cp.filter("m2 >= 4000"), 1500.0, "id", ("x", "y"), ("vx", "vy")).withColumn("big", F.lit(True))
    return am.select("id").join(near, "id", "left").join(big, "id", "left").na.fill(False, ["near", "big"])


@query("j27_unordered_pair", "select least(l_partkey,l_suppkey) as lo, greatest(l_partkey,l_suppkey) as hi, count(*) as n from lineitem group by 1,2")
def j27(t):
    from landgauge.operators.graph import unordered

    return unordered(t.lineitem, "l_partkey", "l_suppkey").groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"))


@query("j28_lookup_needed", "select o_orderkey, o_totalprice from orders where o_custkey in (select c_custkey from customer where c_mktsegment='BUILDING')")
def j28(t):
    need = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return L.lookup_needed(t.orders, need, "o_custkey").select("o_orderkey", "o_totalprice")
