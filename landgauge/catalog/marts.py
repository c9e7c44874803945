"""Queries for the composite marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from landgauge.catalog import bindings as B
from landgauge.catalog import filters as CF
from landgauge.catalog.aggregates import HOTEL_SQL, a36, hotels
from landgauge.catalog.clean import PLACES, pick
from landgauge.catalog.classify import TAGS
from landgauge.catalog.geometry import BLOCK_CELLS_SQL, CELL, block_cover, block_shapes, rings
from landgauge.catalog.joins import BIG, SA, D
from landgauge.catalog.registry import ORACLES, query
from landgauge.functions import geometry as G
from landgauge.functions.clean import norm_name
from landgauge.operators import aggregates as A
from landgauge.operators import gates as GT
from landgauge.operators import overlay as O
from landgauge.operators import spatial as S
from landgauge.plans import land as LP
from landgauge.plans import layers as LY
from landgauge.plans import stations as SP
from landgauge.plans import transport as TP
from landgauge.session import cut_lineage, scratch_path
from landgauge.sources import features as FT
from landgauge.sources import tables as TB

DISC2_SQL = """disc as (select sid, cx, cy, sqrt(pow((cx+0.5)*100-sx,2)+pow((cy+0.5)*100-sy,2)) as d from (select sid, sx, sy, gx.o+cast(floor(sx/100) as int) as cx, gy.o+cast(floor(sy/100) as int) as cy from stations, (select unnest(range(-22,23)) as o) gx, (select unnest(range(-22,23)) as o) gy) where sqrt(pow((cx+0.5)*100-sx,2)+pow((cy+0.5)*100-sy,2))<=2000),
 hard as (select distinct cx, cy from block_cells where kind in ('built_land','green_space','sssi')), soft as (select distinct kind, cx, cy from block_cells where kind in ('conservation_area','green_belt')),
 lft as (select * from disc where not exists (select 1 from hard where hard.cx=disc.cx and hard.cy=disc.cy))"""


@query(
    "m01_developable_land",
    B.ctes(B.STATIONS_SQL, B.BLOCKS_SQL, BLOCK_CELLS_SQL, DISC2_SQL)
    + """, t as (select sid, count(*)*1e0 as ha, count(*) filter (where d<=500)*1e0 as ha_inner from lft group by 1), s as (select sid, count(*) filter (where kind='green_belt')*1e0 as gb, count(*) filter (where kind='conservation_area')*0.4e0 as f from lft join soft using (cx, cy) group by 1)
 select sid, ha, ha_inner, coalesce(gb,0) as green_belt_ha, round(least(1, coalesce(f,0)/ha),3) as friction from t left join s using (sid)""",
)
def m01(t):
    """Whole plots kept (no opening, no minimum plot): exact on grid-aligned rectangles."""
    out = SP.developable_land(B.stations(t), block_shapes(t), CELL, 2000.0, 500.0, 0.0, 0.0)
    return out.select("sid", F.round("ha", 6).alias("ha"), F.round("ha_inner", 6).alias("ha_inner"), F.round("green_belt_ha", 6).alias("green_belt_ha"), "friction")


PLUS = "(0,0),(1,0),(-1,0),(0,1),(0,-1)"


@query(
    "m01_developable_plots",
    B.ctes(B.STATIONS_SQL, B.BLOCKS_SQL, BLOCK_CELLS_SQL).replace("with ", "with recursive ", 1)
    + f""", hard as (select distinct cx, cy from block_cells where kind in ('built_land','green_space','sssi')),
 plus as (select * from (values {PLUS}) p(i, j)),
 lft as (select sid, cx, cy, d from (select sid, gx.o+cast(floor(sx/100) as int) as cx, gy.o+cast(floor(sy/100) as int) as cy, sqrt(pow((gx.o+cast(floor(sx/100) as int)+0.5)*100-sx,2)+pow((gy.o+cast(floor(sy/100) as int)+0.5)*100-sy,2)) as d from stations, (select unnest(range(-11,12)) as o) gx, (select unnest(range(-11,12)) as o) gy) where d<=1000 and not exists (select 1 from hard h where h.cx=cx and h.cy=cy)),
 ero as (select sid, l.cx-i as cx, l.cy-j as cy from lft l, plus group by 1,2,3 having count(*)=5),
 opn as (select distinct sid, e.cx+i as cx, e.cy+j as cy from ero e, plus),
 walk as (select sid, cx as rx, cy as ry, cx, cy from opn union select w.sid, rx, ry, o.cx, o.cy from walk w join opn o on o.sid=w.sid and abs(o.cx-w.cx)+abs(o.cy-w.cy)=1),
 part as (select sid, cx, cy, min(rx*100000+ry) as part from walk group by 1,2,3),
 big as (select sid, part, count(*)*1e0 as ha from part group by 1,2 having count(*)*1e4>=40000),
 kept as (select p.* from part p join big using (sid, part))
 select sid, coalesce(k.ha,0) as ha, coalesce(k.ha_inner,0) as ha_inner, largest_ha, coalesce(n_plots,0) as n_plots from stations
 left join (select sid, count(*)*1e0 as ha, count(*) filter (where d<=200)*1e0 as ha_inner from kept join lft using (sid, cx, cy) group by 1) k using (sid)
 left join (select sid, max(ha) as largest_ha, count(*) as n_plots from big group by 1) b using (sid)""".replace("where h.cx=cx and h.cy=cy", "where h.cx=g.cx and h.cy=g.cy").replace("(select unnest(range(-11,12)) as o) gy) where d<=1000", "(select unnest(range(-11,12)) as o) gy) g where d<=1000"),
)
def m01_plots(t):
    """With opening by a disc of 125 m, minimum plot and largest plot."""
    out = SP.developable_land(B.stations(t), block_shapes(t), CELL, 1000.0, 200.0, 40_000.0, 250.0)
    return out.select("sid", F.round("ha", 6).alias("ha"), F.round("ha_inner", 6).alias("ha_inner"), F.round("largest_ha", 6).alias("largest_ha"), "n_plots")


def assessed(t):
    st = B.stations(t).withColumns({"connected": F.col("sid") % 3 == 0, "tph": F.col("sid") % 11, "per_direction": F.col("sid") % 6})
    land = SP.developable_land(st, block_shapes(t), CELL, 2000.0, 500.0, 0.0, 0.0)
    built = SP.built_fraction(st, block_shapes(t).filter("kind = 'built_land'"), CELL, 2000.0)
    return SP.station_assessments(st, land, built)


@query(
    "m02_station_assessments",
    B.ctes(B.STATIONS_SQL, B.BLOCKS_SQL, BLOCK_CELLS_SQL, DISC2_SQL)
    + """, b as (select sid, avg(case when h.cx is null then 0e0 else 1e0 end) as bf, count(*) filter (where h.cx is not null and d<=100)>0 as near from disc left join (select distinct cx, cy from block_cells where kind='built_land') h using (cx, cy) group by 1), l as (select sid, count(*)*1e0 as ha from lft group by 1),
 a as (select sid, round(bf,6) as built_frac, bf>=0.4 or (bf>=0.2 and near) as inset, ha, sid%3=0 as conn, sid%11 as tph, sid%6 as pd from b join l using (sid)),
 x as (select *, case when inset then 'A' when conn then 'B' else 'ineligible' end as tier, case when conn and (tph>=8 or pd>=4) then 45 when conn or inset then 35 end as density from a)
 select sid, built_frac, inset, tier, density, cast(round(ha*coalesce(density,0)) as bigint) as dwelling_yield from x""",
)
def m02(t):
    return assessed(t).select("sid", F.round("built_frac", 6).alias("built_frac"), "inset", "tier", "density", "dwelling_yield")


def small_areas(t):
    am = B.amenities(t)
    return am.select(F.col("id").alias("area_id"), "x", "y", F.abs("c_acctbal").alias("population"), (F.col("id") % 100).cast("double").alias("imd"), F.when(F.col("id") % 3 > 0, F.col("id") % 50).cast("double").alias("health"))


SOCIO_SQL = SA + f""", p as (select sid, id, {D} as d, abs(c_acctbal) as pop, cast(id%100 as double) as imd, case when id%3>0 then cast(id%50 as double) end as health, kind from stations, amenities),
 c as (select sid, count(*) filter (where d<=2500) as n, sum(pop) filter (where d<=2500) as pop, sum(pop*imd) filter (where d<=2500)/nullif(sum(pop) filter (where d<=2500),0) as imd, sum(pop*health) filter (where d<=2500)/nullif(sum(pop) filter (where d<=2500 and health is not null),0) as health,
  20e0*least(count(*) filter (where d<=2500 and kind='gp'),1)+20*least(count(*) filter (where d<=2500 and kind='pharmacy'),1)+20*least(count(*) filter (where d<=2500 and kind='school'),1)+20*least(count(*) filter (where d<=2500 and kind='nursery'),1)+2*least(count(*) filter (where d<=2500 and kind='bus'),10) as amenity from p group by 1),
 n as (select * from p where d<=30000 qualify row_number() over (partition by sid order by d, id)=1),
 v as (select c.sid, case when c.n>0 then c.pop else n.pop end as catchment_pop, coalesce(c.imd, n.imd) as imd, coalesce(c.health, n.health) as health, amenity, c.sid%90 as conn, c.sid%140 as y from c left join n using (sid))"""


@query(
    "m03_station_socioecon",
    SOCIO_SQL + """ select sid, round(catchment_pop,2) as catchment_pop, round(imd,4) as imd, round(health,4) as health, amenity, round((0.5*imd+0.3*(0.6*amenity+0.4*conn)+0.2*100*percent_rank() over (order by y)),1) as benefit from v""",
)
def m03(t):
    st = B.stations(t).withColumns({"connectivity": F.col("sid") % 90, "dwelling_yield": F.col("sid") % 140})
    out = SP.station_socioecon(st, small_areas(t), B.amenities(t), ["imd", "health"], {"regen": 0.5, "access": 0.3, "housing": 0.2}, 2500.0)
    return out.select("sid", F.round("catchment_pop", 2).alias("catchment_pop"), F.round("imd", 4).alias("imd"), F.round("health", 4).alias("health"), F.col("amenity").cast("double").alias("amenity"), "benefit")


@query(
    "m04_station_prices",
    B.ctes(B.STATIONS_SQL, B.AMENITIES_SQL, B.SALES_SQL)
    + f""", m as (select sid, count(*) as n, quantile_cont(price,0.5) as mp, quantile_cont(ppm2r,0.5) as m2, count(ppm2r) as n2 from stations, sales where {D}<=1500 group by 1),
 ar as (select id, x, y, abs(c_acctbal) as pop, case when id%4>0 then 1000+id%500 end as ppm2, 50000+id as price from amenities), c as (select sid, sum(pop*ppm2)/nullif(sum(pop) filter (where ppm2 is not null),0) as p2, sum(pop*price)/nullif(sum(pop),0) as pr from stations, ar where {D}<=1500 group by 1),
 n as (select sid, ppm2, price from stations, ar where ppm2 is not null and {D}<=30000 qualify row_number() over (partition by sid order by {D}, id)=1)
 select sid, cast(round(coalesce(case when n2>=30 then m2 end, p2, ppm2)) as bigint) as catchment_ppm2, cast(round(coalesce(case when m.n>=30 then mp end, pr, price)) as bigint) as catchment_median_price, coalesce(m.n,0) as n_sales from stations left join m using (sid) left join c using (sid) left join n using (sid)""",
)
def m04(t):
    k = F.col("id")
    areas = B.amenities(t).select(k.alias("area_id"), "x", "y", F.abs("c_acctbal").alias("population"), F.when(k % 4 > 0, 1000 + k % 500).alias("ppm2"), (50000 + k).alias("price"))
    return SP.station_prices(B.stations(t), B.sales(t), areas, 1500.0)


@query("m05_station_scotland", SOCIO_SQL + " select sid, round(catchment_pop,2) as catchment_pop, round(imd,4) as imd from v")
def m05(t):
    """The northern variant: one score, same catchment-else-nearest rule."""
    st = B.stations(t).withColumns({"connectivity": F.lit(0), "dwelling_yield": F.lit(0)})
    out = SP.station_socioecon(st, small_areas(t), B.amenities(t), ["imd"], {"regen": 1, "access": 0, "housing": 0}, 2500.0)
    return out.select("sid", F.round("catchment_pop", 2).alias("catchment_pop"), F.round("imd", 4).alias("imd"))


@query(
    "m06_station_lookups",
    B.ctes(B.STATIONS_SQL, B.AREAS_SQL) + "select sid, area_id, area_name, area_id*10 as land_value, case when area_id%3=0 then 'none' else 'adopted' end as cil_status from stations left join areas on sx>=minx and sx<maxx and sy>=miny and sy<maxy",
)
def m06(t):
    areas = rings(B.areas(t), "area_id")
    facts = areas.select("area_id", "area_name", (F.col("area_id") * 10).alias("land_value"), F.when(F.col("area_id") % 3 == 0, "none").otherwise("adopted").alias("cil_status"))
    return SP.station_lookups(B.stations(t), areas, facts, BIG).select("sid", "area_id", "area_name", "land_value", "cil_status")


@query(
    "m07_grey_belt",
    B.ctes(B.BLOCKS_SQL, BLOCK_CELLS_SQL).replace("with ", "with recursive ", 1)
    + """, belt as (select distinct cx, cy from block_cells where kind='green_belt'),
 built as (select distinct cx+1 as cx, cy+1 as cy from block_cells where kind='green_belt'),
 hard as (select distinct cx+3 as cx, cy+2 as cy from block_cells where kind='green_belt' and block_id%3=0),
 lft as (select cx, cy from belt intersect select cx, cy from built except select cx, cy from hard),
 walk as (select cx as rx, cy as ry, cx, cy from lft union select rx, ry, o.cx, o.cy from walk w join lft o on abs(o.cx-w.cx)+abs(o.cy-w.cy)=1),
 part as (select cx, cy, min(rx*100000+ry) as part from walk group by 1,2),
 plots as (select part, count(*)*1e0 as ha, min(cx) as cx, min(cy) as cy from part group by 1)
 select cast(round(ha*1e4) as bigint) as m2, count(*) as n, sum(cx)::bigint as cxs, sum(cy)::bigint as cys, least(1, min(rank))::bigint as first
 from (select *, row_number() over (order by ha desc) as rank from plots) group by 1""",
)
def m07(t):
    """Built land (the belt's blocks 100 m on) inside the belt less hard designations; plots of equal size are counted together."""
    belt = B.blocks(t).filter("kind = 'green_belt'").select("block_id", "minx", "miny", "maxx", "maxy")

    def at(df, kind, dx, dy):
        box = G.rect_rings(F.col("minx") + dx, F.col("miny") + dy, F.col("maxx") + dx, F.col("maxy") + dy)
        return df.select(F.lit(kind).alias("kind"), box.alias("rings"))

    hard = at(belt.withColumn("_third", F.col("block_id") % 3).filter("_third = 0"), "sssi", 300, 200)
    plots = LP.grey_belt(at(belt, "green_belt", 0, 0).unionByName(at(belt, "built_land", 100, 100)).unionByName(hard), CELL)
    return plots.groupBy(F.round(F.col("ha") * 1e4).cast("bigint").alias("m2")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("cx").alias("cxs"), F.sum("cy").alias("cys"), F.least(F.lit(1), F.min("number")).cast("bigint").alias("first")
    )


GROUPS = {"built": ("built_land",), "protected": ("sssi", "conservation_area")}


@query(
    "m08_power_grid",
    B.ctes(B.BLOCKS_SQL, BLOCK_CELLS_SQL, B.STATIONS_SQL)
    + """, seed as (select distinct cast(floor(x/1000) as int) as gx, cast(floor(y/1000) as int) as gy from (select cast((p_partkey*7919)%100000 as double) as x, cast((p_partkey*104729)%100000 as double) as y from part)),
 c as (select cast(cx//10 as int) as gx, cast(cy//10 as int) as gy, cast(count(distinct cx*100000+cy) filter (where kind='built_land') as int) as built_pct, cast(count(distinct cx*100000+cy) filter (where kind in ('sssi','conservation_area')) as int) as protected_pct from block_cells group by 1,2)
 select gx, gy, coalesce(built_pct,0) as built_pct, coalesce(protected_pct,0) as protected_pct, cast(least(255, coalesce((select round(min(sqrt(pow(gx*1000+500-sx,2)+pow(gy*1000+500-sy,2)))/100) from stations where sqrt(pow(gx*1000+500-sx,2)+pow(gy*1000+500-sy,2))<=25000),255)) as int) as d_sub132 from seed left join c using (gx, gy)""",
)
def m08(t):
    seed = B.venues(t).select(F.floor(F.col("x") / 1000).cast("int").alias("gx"), F.floor(F.col("y") / 1000).cast("int").alias("gy")).distinct()
    seed = seed.withColumn("x", F.col("gx") * 1000 + 500.0).withColumn("y", F.col("gy") * 1000 + 500.0)
    comp = A.cell_composition(block_shapes(t), GROUPS, 1000.0)
    subs = B.stations(t).select(F.col("sid").alias("id"), F.col("sx").alias("x"), F.col("sy").alias("y"))
    return LP.power_grid(seed, comp, {"d_sub132": subs}).select("gx", "gy", "built_pct", "protected_pct", "d_sub132")


SIFT_OK = "o_orderkey%23<=10 and o_orderkey%41<=20 and o_orderkey%37<=20 and o_orderkey%11<=5 and greatest(o_orderkey%19-1,0)<=10 and o_orderkey%70<=50 and o_orderkey%91<=50"


@query(
    "m09_sift_stats",
    f"select o_custkey as lad, count(*) as km2, (select count(*) from orders) as total_cells, (select count(*) from orders where {SIFT_OK}) as green_cells from orders where {SIFT_OK} group by 1 order by km2 desc, lad limit 15",
)
def m09(t):
    return LP.sift_stats(CF.grid(t), {}, "lad")


@query(
    "m10_application_rates",
    B.ctes(B.AMENITIES_SQL, B.AREAS_SQL)
    + """, a as (select id, case when id%3>0 then x end as x, y, 'nation_'||(id%30) as nm, case id%4 when 0 then 'refused' when 1 then 'pending' else 'approved' end as st from amenities),
 k as (select coalesce(s.area_id, n.area_id) as area_id, st from a left join areas s on a.x>=s.minx and a.x<s.maxx and a.y>=s.miny and a.y<s.maxy left join areas n on lower(n.area_name)=a.nm)
 select area_id, count(*) as n, count(*) filter (where st='approved') as approved, count(*) filter (where st='refused') as refused, count(*) filter (where st='pending') as pending, case when count(*) filter (where st<>'pending')>=5 then round(100.0*count(*) filter (where st='approved')/count(*) filter (where st<>'pending'),1) end as approval_pct from k where area_id is not null group by 1""",
)
def m10(t):
    k = F.col("id")
    apps = B.amenities(t).select("id", F.when(k % 3 > 0, F.col("x")).alias("x"), "y", F.concat(F.lit("City of NATION_"), (k % 30).cast("string")).alias("council"), F.when(k % 4 == 0, "refused").when(k % 4 == 1, "pending").otherwise("approved").alias("state"))
    return LP.application_rates(apps, rings(B.areas(t), "area_id"), BIG)


@query(
    "m10_estate",
    B.ctes(B.AMENITIES_SQL, B.VENUES_SQL)
    + """, a as (select *, id%3 as prio from amenities), k as (select id, x, y from a where not exists (select 1 from a b where b.id<>a.id and sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))<=1500 and (b.prio<a.prio or (b.prio=a.prio and b.id<a.id))))
 select 'estate' as status, id from k union all select 'live', id from venues v where not exists (select 1 from k where sqrt(pow(v.x-k.x,2)+pow(v.y-k.y,2))<=1000)""",
)
def m10_estate(t):
    sites = B.amenities(t).withColumn("prio", F.col("id") % 3).select("id", "x", "y", "prio")
    return LP.estate(sites, B.venues(t).select("id", "x", "y"), 1500.0, 1000.0).select("status", "id")


@query(
    "m11_council_control",
    "select n_nationkey as area_id, n_name as area_name, case when n_nationkey%4>0 then r_name end as control from nation join region on r_regionkey=n_regionkey",
)
def m11(t):
    areas = t.nation.select(F.col("n_nationkey").alias("area_id"), "n_name", "n_regionkey")
    council = F.when(F.col("area_id") % 2 == 0, F.concat(F.lit("City of "), F.col("n_name"))).otherwise(F.col("n_name"))
    control = areas.filter("area_id % 4 > 0").join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("council"), F.col("r_name").alias("control"), F.lit("x").alias("largest"))
    out = LP.council_control(areas.select("area_id", council.alias("area_name")), control)
    return out.join(areas.select("area_id", "n_name"), "area_id").select("area_id", F.col("n_name").alias("area_name"), "control")


@query(
    "m12_office_rents_near",
    SA + f""", c as (select sid, count(*) filter (where {D}<=2000) a, count(*) filter (where {D}<=5000) b, count(*) filter (where {D}<=10000) c from stations, amenities group by 1), r as (select sid, case when a>=5 then 2000 when b>=5 then 5000 when c>=5 then 10000 else 25000 end::double as radius from c),
 p as (select sid, r.radius, c_acctbal as pm2 from stations join r using (sid), amenities where {D}<=r.radius)
 select sid, radius, count(*) as n, round(quantile_cont(pm2,0.25),4) as p25, round(quantile_cont(pm2,0.5),4) as p50, round(quantile_cont(pm2,0.75),4) as p75, least(count(*),12) as n_evidence from p group by 1,2""",
)
def m12(t):
    out = LP.office_rents_near(B.stations(t), B.amenities(t).withColumn("pm2", F.col("c_acctbal")))
    return out.select("sid", "radius", "n", *[F.round(p, 4).alias(p) for p in ("p25", "p50", "p75")], F.size("evidence").cast("bigint").alias("n_evidence"))


DA = "sqrt(pow(a.x-s.x,2)+pow(a.y-s.y,2))"


@query(
    "m13_candidate_sites",
    B.ctes(B.SITES_SQL, B.BLOCKS_SQL, BLOCK_CELLS_SQL, B.STATIONS_SQL, B.AMENITIES_SQL, B.VENUES_SQL)
    + f""", p as (select site_id as id, case when site_id%2=0 then 'register' else 'osm_retail' end as src, (minx+maxx)/2 as x, (miny+maxy)/2 as y, minx, miny, maxx, maxy from sites),
 s as (select * from p where src='register' or not exists (select 1 from blocks b where b.kind='green_space' and p.x>=b.minx and p.x<b.maxx and p.y>=b.miny and p.y<b.maxy)),
 stn as (select s.id, min(sqrt(pow(sx-s.x,2)+pow(sy-s.y,2))) as d from s, stations where sqrt(pow(sx-s.x,2)+pow(sy-s.y,2))<=3000 group by 1),
 k8 as (select s.id, a.id as stop, a.id%40 as mins, {DA} as d from s, amenities a where {DA}<=3000 qualify row_number() over (partition by s.id order by {DA}, a.id)<=8),
 z as (select id, min(mins+d*1.25/80) as z1 from k8 group by 1),
 o as (select s.id, count(*) as n, quantile_cont(cap::double, 0.5) as med from s, venues a where {DA}<=1000 group by 1),
 c as (select distinct kind, cx*100.0 as cx, cy*100.0 as cy from block_cells where kind<>'green_space'),
 f as (select id, kind from s join c on cx<maxx and cx+100>minx and cy<maxy and cy+100>miny group by 1, 2 having sum((least(maxx,cx+100)-greatest(minx,cx))*(least(maxy,cy+100)-greatest(miny,cy)))>=0.1*any_value((maxx-minx)*(maxy-miny)))
 select s.id, src, s.x, s.y, round((maxx-minx)*(maxy-miny)/1e4,6) as area_ha, round(stn.d,4) as stn_m, round(z1,4) as z1_min, coalesce(o.n,0) as office_n, round(med,4) as office_voa_pm2,
 {', '.join(f"exists(select 1 from f where f.id=s.id and kind='{k}') as in_{k}" for k in B.KINDS if k != 'green_space')}
 from s left join stn using (id) left join z using (id) left join o using (id)""",
)
def m13(t):
    """Register and other sites with access, office market and policy flags."""
    s = rings(B.sites(t), "site_id").withColumn("x", (F.col("minx") + F.col("maxx")) / 2).withColumn("y", (F.col("miny") + F.col("maxy")) / 2)
    src = F.when(F.col("site_id") % 2 == 0, "register").otherwise("osm_retail")
    sites = s.select(F.col("site_id").alias("id"), src.alias("src"), "rings", "x", "y")
    green = rings(B.blocks(t).filter("kind = 'green_space'"), "block_id").select(F.col("block_id").alias("gid"), "rings")
    layers = rings(B.blocks(t).filter("kind <> 'green_space'"), "block_id").select(F.col("kind").alias("layer"), "rings")
    stops = B.amenities(t).select(F.col("id").alias("stop"), "x", "y", (F.col("id") % 40).cast("double").alias("mins"))
    market = B.venues(t).select("id", "x", "y", F.col("cap").alias("pm2"))
    out = LP.candidate_sites(sites.filter("src = 'register'"), sites.filter("src <> 'register'"), green, stops, B.stations(t), market, layers, CELL)
    return out.select(*[F.round(c, 6 if c == "area_ha" else 4).alias(c) if c in ("area_ha", "stn_m", "z1_min", "office_voa_pm2") else c for c in out.columns])


@query(
    "m14_site_sift",
    f"""with {CF.CAND_SQL}, r as (select *, {CF.mid_sql('z1_min', 'p1', True)}, {CF.mid_sql('conn_pt', 'p2', False)} from cand)
 select id, cast(round(100*(2*p1+coalesce(p2,0))/(2+case when p2 is null then 0 else 1 end)) as int) as score from r where src<>'green_space' and {CF.LAND_OK} and z1_min<=30""",
)
def m14(t):
    """All sites that pass, with their score: land filter, zone filter that also scores, connectivity score."""
    kept, _ = GT.run_gates(CF.candidates(t), "id", [GT.gate("land"), GT.gate("z1", "filter", value=30), GT.gate("conn", "score")])
    return kept.select("id", "score")


@query(
    "m15_derive_stadia",
    """select p_partkey as id, case when p_partkey%2=0 then 'Premier League' when p_partkey%3=0 then 'Cricket' else 'Non-league / other' end as tier, cast(round(p_size*200*(case when p_partkey%2=0 then 0.96 when p_partkey%3=0 then 0.45 else 0.30 end)*(case when p_partkey%2=0 then 25 when p_partkey%3=0 then 30 else 21 end)) as bigint) as annual_visits,
 365-(case when p_partkey%2=0 then 25 when p_partkey%3=0 then 30 else 21 end) as idle_days, round(100.0*(p_partkey%900)/nullif(p_size*200,0),1) as beds_per_100, round((p_partkey%5000)::double/nullif(p_partkey%7000,0),3) as pt_share from part""",
)
def m15(t):
    k = F.col("p_partkey")
    m = t.part.select(
        k.alias("id"), F.when(k % 2 == 0, "Premier League").alias("league"), F.when(k % 3 == 0, "Cricket").otherwise("Football").alias("sport"), (F.col("p_size") * 200).alias("capacity"),
        (k % 3000).alias("pop_800"), (k % 900).alias("jobs_800"), (k % 900).alias("beds_5k"), (k % 5000).alias("reach_pt45"), (k % 7000).alias("reach_drive20"),
    )
    return LP.derive_stadia(m).select("id", "tier", "annual_visits", "idle_days", "beds_per_100", "pt_share")


@query(
    "m16_catchment_summary",
    B.ctes(B.STATIONS_SQL, B.VENUES_SQL) + f"select sid, p_type, count(*) as n, sum(cap) as cap, count(*) filter (where {D}<=1000) as n_1km, count(*) filter (where {D}<=3000) as n_3km, count(*) filter (where {D}<=5000) as n_5km from stations, venues where {D}<=5000 group by 1,2",
)
def m16(t):
    """Breakdown by type and distance band around every origin."""
    wanted = [("cap", 5000), *[("n", 1000 * b) for b in (1, 3, 5)]]
    sums = S.catchment_sums_by(B.stations(t), "sid", B.venues(t), {"n": F.lit(1), "cap": F.col("cap")}, wanted, ["p_type"])
    bands = [F.coalesce(f"n_{b}000", F.lit(0)).alias(f"n_{b}km") for b in (1, 3, 5)]
    return sums.select("sid", "p_type", F.col("n_5000").alias("n"), F.col("cap_5000").alias("cap"), *bands)


@query("m17_transit_reach")
def m17(t):
    """People within a 45-minute transit trip of every origin, from earliest arrivals."""
    from landgauge.catalog.graphs import gr03, pt_stops

    reached = gr03(t).join(pt_stops(t), "stop").select("origin", "x", "y", "t")
    people = B.amenities(t).select((F.col("x") * 0.03).alias("x"), (F.col("y") * 0.03).alias("y"), F.abs("c_acctbal").alias("pop"))
    return LP.reach_population(reached, people, 45 * 60, CELL)


@query(
    "m18_bus_network",
    B.ctes(B.CALLS_SQL) + """select stop, count(*) as trips_day, count(*) filter (where hour between 7 and 18) as deps_day from calls where (trip%7=2 and trip%11<>5) or trip%13=4 and trip%11<>5 group by 1""",
)
def m18(t):
    k = F.col("trip")
    trips = B.calls(t).select("trip").distinct().select("trip", k.alias("service_id"), F.concat(F.lit("R"), (k % 30).cast("string")).alias("route"))
    cal = trips.select(
        "service_id", *[(F.col("service_id") % 7 == i).cast("int").alias(d) for i, d in enumerate(("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"))],
        F.lit("2024-01-01").cast("date").alias("start_date"), F.lit("2024-12-31").cast("date").alias("end_date"),
    )
    s = F.col("service_id")
    exc = trips.select("service_id", F.when(s % 11 == 5, 2).when(s % 13 == 4, 1).otherwise(0).alias("exception_type"), F.lit("2024-06-05").cast("date").alias("date"))
    stops, _links = TP.bus_network(B.calls(t), trips, cal, exc, F.lit("2024-06-05").cast("date"))
    return stops.select("stop", "trips_day", "deps_day")


@query("m19_station_timetable", B.ctes(B.CALLS_SQL) + "select stop, count(*) as departures, count(*) filter (where hour between 7 and 9) as peak, min(minute) as first_dep, max(minute) as last_dep from calls group by 1")
def m19(t):
    out = TP.station_timetable(B.calls(t), ["purchase"], F.col("value") * 7)
    return out.select("stop", "departures", "peak", "first_dep", "last_dep")


@query("m20_track_usage")
def m20(t):
    """Schedules resolved for the day, their calls put on a ladder of track (rows only; overlay choice and load assignment are checked on their own)."""
    from landgauge.catalog.graphs import ladder

    k = F.col("o_orderkey")
    sched = t.orders.select(F.col("o_custkey").alias("uid"), k.alias("ord"), F.when(k % 6 == 3, "C").otherwise("P").alias("stp"), (k % 7 > 0).alias("passenger"), F.lit("1998-01-01").cast("date").alias("runs_from"), F.lit("1999-01-01").cast("date").alias("runs_to"))
    base = F.floor(F.col("l_suppkey") / 20) * 20
    calls = t.lineitem.select(F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("seq"), (base + F.col("l_partkey") % 20).alias("stop"))
    n = F.col("s_suppkey")
    stations = t.supplier.select(n.alias("stop"), n.alias("node"), (n % 20 * 100.0).alias("x"), (F.floor(n / 20) * 500.0).alias("y"))
    return TP.track_usage(sched, calls, F.lit("1998-06-01").cast("date"), stations, ladder(t, "s_suppkey", "supplier"))


@query(
    "m21_road_traffic",
    B.ctes(B.VENUES_SQL, B.AMENITIES_SQL)
    + """, ct as (select o_custkey as point_id, max_by(o_totalprice, (year(o_orderdate), o_orderkey)) as flow from orders group by 1), pt as (select id, id%10 as road, x, y, flow from amenities join ct on id=point_id)
 select v.id as link_id, flow from venues v join pt on v.id%10=pt.road and sqrt(pow(v.x-pt.x,2)+pow(v.y-pt.y,2))<=case v.id%3 when 0 then 4000 when 1 then 3000 else 1500 end qualify row_number() over (partition by v.id order by sqrt(pow(v.x-pt.x,2)+pow(v.y-pt.y,2)), pt.id)=1""",
)
def m21(t):
    cust = B.amenities(t).select(F.col("id").alias("o_custkey"), (F.col("id") % 10).alias("road"), "x", "y")
    yearly = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.max_by("o_totalprice", "o_orderkey").alias("flow"))
    counts = yearly.join(cust, "o_custkey").withColumnRenamed("o_custkey", "point_id")
    k = F.col("id")
    links = B.venues(t).select(k.alias("link_id"), (k % 10).alias("road"), F.when(k % 3 == 0, "M").when(k % 3 == 1, "A").otherwise("B").alias("cls"), F.col("x").alias("lx"), F.col("y").alias("ly"), k.alias("a"), (k + 1).alias("b"))
    return TP.road_traffic(cut_lineage(counts), links)[0].select("link_id", "flow")


@query(
    "m22_sales_layer",
    """with sl as (select l_orderkey||'-'||l_linenumber as sale_id, l_suppkey as pc, cast(l_partkey%60 as varchar) as paon, cast(round(l_extendedprice) as bigint) as price from lineitem where l_returnflag='A' and cast(l_shipdate as date)>=date '1998-01-01' and l_suppkey%9>0),
 s1 as (select sale_id, any_value(pc) as pc, any_value(paon) as paon, any_value(price) as price from sl group by 1 having count(*)=1),
 ce as (select l_suppkey as pc, cast(l_partkey%60 as varchar) as paon, max_by(l_quantity, (l_shipdate, l_orderkey*10+l_linenumber)) as m2 from lineitem where l_returnflag='N' and l_linenumber=1 group by 1,2)
 select count(*) as n, count(m2) as linked, count(*) filter (where m2 between 15 and 600 and price/m2 between 300 and 30000) as measured, round(sum(case when m2 between 15 and 600 and price/m2 between 300 and 30000 then price/m2 end),2) as ppm2 from s1 left join ce using (pc, paon)""",
)
def m22(t):
    one = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("_n"), F.count_if((F.col("l_returnflag") == "A") & (F.to_date("l_shipdate") >= "1998-01-01") & (F.col("l_suppkey") % 9 > 0)).alias("_k")).filter("_k = 1").select("l_orderkey", "l_linenumber")
    li = t.lineitem.join(one, ["l_orderkey", "l_linenumber"])
    pc, paon = F.col("l_suppkey").cast("string"), (F.col("l_partkey") % 60).cast("string")
    street = F.lit("High Street")
    sales = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sale_id"), F.col("l_returnflag").alias("category"), F.to_date("l_shipdate").alias("sold"), F.when(F.col("l_suppkey") % 9 > 0, pc).alias("postcode"),
        F.round("l_extendedprice").cast("bigint").cast("string").alias("price_text"), F.lit(None).cast("string").alias("saon"), paon.alias("paon"), street.alias("street"), F.lit(0.0).alias("lng"), F.lit(51.0).alias("lat"),
    )
    certs = t.lineitem.filter("l_returnflag = 'N' and l_linenumber = 1").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cert_id"), pc.alias("postcode"), F.lit(None).cast("string").alias("saon"), paon.alias("paon"), street.alias("street"), F.col("l_quantity").alias("m2"), F.col("l_shipdate").alias("lodged"))
    out = LY.sales_layer(sales, certs, 36, F.lit("2001-01-01").cast("date"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count("m2").alias("linked"), F.count("ppm2r").alias("measured"), F.round(F.sum("ppm2r"), 2).alias("ppm2"))


@query("m23_public_estate")
def m23(t):
    """Titles to owner classes, to postcode points, to parcels (rows only; the pairing rules are tested by scenario)."""
    from landgauge.catalog.classify import ADDRESSES, CATEGORIES, OWNERS
    from landgauge.catalog.joins import parcels

    df = t.orders.withColumn("k", F.col("o_orderkey"))
    titles = df.select((F.col("o_custkey") % 500).alias("postcode"), pick("k", ADDRESSES).alias("address"), F.col("k").alias("ord"), F.array(pick("k", OWNERS), pick("o_custkey", OWNERS)).alias("names"), F.array(pick("k", CATEGORIES), pick("o_custkey", CATEGORIES)).alias("categories"))
    pcs = B.amenities(t).select(F.col("id").alias("postcode"), "x", "y")
    return LY.public_estate(titles, pcs, parcels(t), 250.0, 800.0, 360_000.0)


@query(
    "m24_brownfield_register",
    B.ctes(B.AMENITIES_SQL, B.SITES_SQL)
    + """select cast(a.id as varchar) as reference, round(id%100/10e0,4) as hectares_raw, case when id%100>0 then id%100/10e0 end as hectares, case id%3 when 0 then true when 1 then false end as is_public, cast(id%50 as int) as min_dwellings, p.site_id as parcel_id
 from amenities a left join (select z.id as zid, site_id from amenities z join sites on x>=minx and x<maxx and y>=miny and y<maxy qualify row_number() over (partition by z.id order by (maxx-minx)*(maxy-miny), site_id)=1) p on p.zid=a.id""",
)
def m24(t):
    from landgauge.catalog.joins import parcels

    k = F.col("id")
    raw = B.amenities(t).select(
        k.cast("string").alias("SiteReference"), F.concat(F.lit("Site  "), k.cast("string")).alias("SiteNameAddress"), (k % 100 / 10).cast("string").alias("Hectares"),
        F.when(k % 3 == 0, "owned-by-a-public-authority").when(k % 3 == 1, "not-owned-by-a-public-authority").alias("OwnershipStatus"), (k % 50).cast("string").alias("MinNetDwellings"), F.lit("2020-02-30").alias("PermissionDate"),
        F.concat(F.lit("POINT("), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(")")).alias("geom"),
    )
    out = LY.brownfield_register(raw, parcels(t), 250.0)
    return out.select("reference", F.round(F.col("reference").cast("bigint") % 100 / 10, 4).alias("hectares_raw"), "hectares", "is_public", "min_dwellings", "parcel_id")


@query(
    "m25_deprivation_layer",
    """select c_custkey, round((rank() over (order by c_acctbal)+(count(*) over (partition by c_acctbal)-1)/2.0)/count(*) over ()*100,1) as overall_pct, round((rank() over (order by c_custkey%40)+(count(*) over (partition by c_custkey%40)-1)/2.0)/count(*) over ()*100,1) as health_pct,
 case when c_custkey%5>0 then c_custkey*3 end as population, case when c_custkey%5>0 then 'ok' else 'no_data' end as status from customer""",
)
def m25(t):
    k = F.col("c_custkey")
    scores = t.customer.select("c_custkey", F.col("c_acctbal").alias("overall"), (k % 40).alias("health"))
    people = t.customer.filter(k % 5 > 0).select("c_custkey", (k * 3).alias("population"))
    return LY.deprivation_layer(scores, "c_custkey", ["overall", "health"], people)


@query(
    "m26_station_usage",
    """with u as (select o_custkey as id, 'customer '||lpad(cast(o_custkey as varchar),9,'0') as nm, year(o_orderdate) as y, sum(o_totalprice) as e, count(*) as s from orders group by 1,2,3), l as (select id, nm, max(e) filter (where y=1998) as entries, max(s) filter (where y=1998) as season, count(*) as n_years from u group by 1,2),
 j as (select c_custkey as key, l.entries, l.season, l.n_years, case when l.id is null then 'unmatched' when c_custkey%4=0 then 'name' else 'id' end as matched_by from customer left join l on l.id=c_custkey),
 p as (select key, round((row_number() over (order by entries, key)-1)/cast(count(*) over () as double),6) as pct from j where entries is not null)
 select key, round(entries,2) as entries, round(season/entries,3) as season_share, n_years, matched_by, pct as usage_pctile from j left join p using (key)""",
)
def m26(t):
    k = F.col("c_custkey")
    nm = norm_name(F.concat(F.lit("Customer "), F.lpad(k.cast("string"), 9, "0")), "station")
    st = t.customer.select(k.alias("key"), F.when(k % 4 > 0, k).alias("id"), nm.alias("nm"))
    nm2 = norm_name(F.concat(F.lit("Customer "), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(" Rail Station")), "station")
    usage = t.orders.groupBy(F.col("o_custkey").alias("id"), nm2.alias("nm"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("entries"), F.count(F.lit(1)).alias("season"))
    out = LY.station_usage(st, usage, 1998)
    return out.select("key", F.round("entries", 2).alias("entries"), "season_share", F.when(F.col("trend").isNotNull(), F.size("trend")).cast("bigint").alias("n_years"), "matched_by", F.round("usage_pctile", 6).alias("usage_pctile"))


@query(
    "m27_tag_stations",
    B.ctes(B.STATIONS_SQL, B.AREAS_SQL) + """, g as (select c_nationkey as area_id, sum(c_acctbal) as gva from customer group by 1), r as (select area_id, row_number() over (order by gva desc, area_id) as area_rank from g)
 select sid, area_id, area_rank, case when area_id%2=0 then 'urban' else 'rural' end as regime, sid%3>0 and coalesce(area_rank<=10,false) as well_connected from stations left join areas on sx>=minx and sx<maxx and sy>=miny and sy<maxy left join r using (area_id)""",
)
def m27(t):
    st = B.stations(t).withColumn("meets_frequency", F.col("sid") % 3 > 0)
    gva = t.customer.groupBy(F.col("c_nationkey").alias("area_id")).agg(F.sum("c_acctbal").alias("gva"))
    k = F.col("n_nationkey")
    ruc = t.nation.select(k.alias("area_id"), F.when(k % 2 == 0, "Urban major conurbation").alias("ruc_name"), F.when(k % 2 == 1, "E1").alias("ruc_code"))
    return LY.tag_stations(st, rings(B.areas(t), "area_id"), gva, ruc, BIG, 10).select("sid", "area_id", "area_rank", "regime", "well_connected")


@query(
    "m28_transport_constraint",
    """with r as (select p_partkey as line_id, (['Motorway','A Road','B Road','Minor Road'])[cast(p_partkey%4 as int)+1] as cls, p_partkey%9=0 as rail from part),
 w as (select *, case when rail then 12e0 when cls='Motorway' then 15e0 when cls='A Road' then 9e0 when cls='B Road' then 5e0 else 6e0 end as w from r)
 select cls, w as half_width, count(*) as n, round(sum(2*w*sqrt(400*400+50*50)+16*w*w*sin(pi()/16)),2) as area_m2 from w group by 1,2""",
)
def m28(t):
    """Road and rail centre lines grown by class: the exact area of every line, summed per class and width."""
    k = F.col("p_partkey")
    lines = t.part.select(k.alias("line_id"), pick("p_partkey", ["Motorway", "A Road", "B Road", "Minor Road"]).alias("cls"), (k % 9 == 0).alias("is_rail"), (k % 500 * 100.0).alias("x1"), (k % 70 * 300.0).alias("y1"), (k % 500 * 100.0 + 400).alias("x2"), (k % 70 * 300.0 + 50).alias("y2"))
    keys = ["cls", "half_width", "line_id"]
    each = O.total(O.union(O.fragments(LY.transport_constraint(lines), keys, 200.0), keys, 200.0), keys)
    return each.groupBy("cls", "half_width").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 2).alias("area_m2"))


@query(
    "m29_planning_layer",
    """select 'E'||lpad(cast(c_custkey as varchar),6,'0') as code, case when c_custkey%7>0 then c_acctbal end as rent, case when c_custkey%5=0 then 'unknown' when c_custkey%5=1 then 'none' else 'adopted' end as cil_status, case when c_custkey%5=0 then null when c_custkey%5=1 then 0 else cast(round(100+c_custkey%60+25) as int) end as cil_pm2,
 round(case when 3+c_custkey%10<=5 then 1 else (3+c_custkey%10-5)/5.0*0.95+1 end,3) as factor, cast(round(abs(c_acctbal)*20*0.008*(case when 3+c_custkey%10<=5 then 1 else (3+c_custkey%10-5)/5.0*0.95+1 end)) as bigint) as lhn, 'ok' as status from customer""",
)
def m29(t):
    k = F.col("c_custkey")
    code, nm = F.concat(F.lit("E"), F.lpad(k.cast("string"), 6, "0")).alias("code"), norm_name(F.col("c_name"), "council").alias("nm")
    areas = t.customer.select(code, nm)
    rents = t.customer.filter(k % 7 > 0).select(F.when(k % 3 == 0, F.concat(F.lit("Eold"), k.cast("string"))).otherwise(F.concat(F.lit("E"), F.lpad(k.cast("string"), 6, "0"))).alias("code"), nm, F.col("c_acctbal").alias("rent"))
    rates = t.customer.filter(k % 5 > 0).select(nm, F.when(k % 5 == 1, "none").otherwise("adopted").alias("rate_status"), (100 + k % 60).alias("typical"), F.lit(25).alias("mayoral"), F.lit(False).alias("scheduled"), F.lit(False).alias("adopted"))
    return LY.planning_layer(areas, rents, rates, t.customer.select(code, (F.abs("c_acctbal") * 20).alias("stock")), t.customer.select(code, (3 + k % 10).alias("ratio")))


@query(
    "m30_energy_layer",
    B.ctes(B.AREAS_SQL)
    + """, q as (select cast((b*7919)%100000 as double) as x, cast((b*104729)%100000 as double) as y, p_size from (select (p_partkey//50)*50 as b, p_size from part))
 select area_id, sum(p_size)::bigint as mw, count(*) as n from q join areas on x>=minx and x<maxx and y>=miny and y<maxy group by 1""",
)
def m30(t):
    """Every part waits in the queue of the substation that its site text names; megawatts per area."""
    k = F.col("p_partkey")
    base = (F.floor(k / 50) * 50).alias("p_partkey")
    sites = t.part.select(base).distinct()
    subs = B.points(sites, "p_partkey", F.concat(pick("p_partkey", PLACES), F.lit(" unit"), F.col("p_partkey")).alias("name"), F.lit("132000;33000").alias("volts")).withColumnRenamed("id", "sub_id")
    queue = t.part.withColumn("base", F.floor(k / 50) * 50).select(k.alias("q_id"), F.concat(pick("base", PLACES), F.lit(" unit"), F.col("base"), F.lit(" 400kV substation")).alias("site"), F.col("p_size").cast("long").alias("mw"))
    return LY.energy_layer(cut_lineage(subs), queue, rings(B.areas(t), "area_id"), BIG)[1]


@query(
    "m31_buildings_layer",
    """select p_partkey, round(p_size/2e0,1) as raw, case when p_size/2e0>1.5 then round(p_size/2e0,1) end as height_m, case when p_size/2e0>1.5 then cast(p_partkey%9+1 as int) end as storeys, case when p_size/2e0<=1.5 then 'unknown' when round(p_size/2e0,1)>=25 then 'high' when round(p_size/2e0,1)>=12 then 'mid' else 'low' end as height_class from part""",
)
def m31(t):
    h = F.col("p_size") / 2
    tags = F.concat(F.lit('"height"=>"'), h.cast("string"), F.lit(' m","building:levels"=>"'), (F.col("p_partkey") % 9 + 1).cast("string"), F.lit('"'))
    df = t.part.withColumn("tags", tags)
    out = LY.buildings_layer(df, "tags", "p_partkey")
    return out.join(t.part.select("p_partkey", F.round(h, 1).alias("raw")), "p_partkey")


@query("m32_low_value_layer")
def m32(t):
    """Tagged features against sized car parks (classifier and proximity have their own oracles)."""
    sets = t.spark.createDataFrame(list(enumerate(TAGS)), "k bigint, tags map<string,string>")
    f = B.venues(t).withColumn("k", F.col("id") % len(TAGS)).join(F.broadcast(sets), "k").select("id", "tags", (F.col("p_size") * 400.0).alias("area"), "x", "y")
    lots = B.amenities(t).select("x", "y", (F.col("id") % 100 * 100.0).alias("area"))
    return LY.low_value_layer(f, lots)


@query(
    "m33_hotels",
    f"""with {HOTEL_SQL}, tg as (select * from h where tagged between 1 and 2000), b as (select brand, quantile_cont(tagged,0.5) as bm from tg where brand is not null group by 1 having count(*)>=5)
 select kind, count(*) as n, count(*) filter (where tagged between 1 and 2000) as n_tagged, count(*) filter (where not coalesce(tagged between 1 and 2000,false) and bm is not null) as n_brand from h left join b using (brand) group by 1""",
)
def m33(t):
    h = A.impute_rooms(hotels(t))
    return h.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rooms_src") == "tagged").alias("n_tagged"), F.count_if(F.col("rooms_src") == "brand").alias("n_brand"))


@query(
    "m34_office_values",
    "select count(*) as n, round(sum(p_retailprice),2) as rate from part where p_retailprice between 20 and 3000 and p_size>=15",
)
def m34(t):
    k = F.col("p_partkey")
    lines = t.part.select(k.alias("uarn"), (k % 500).alias("postcode"), F.col("p_retailprice").alias("rate_pm2"), F.col("p_size").alias("m2"))
    pcs = t.part.select((k % 500).alias("postcode")).distinct().withColumns({"lng": F.lit(0.0), "lat": F.lit(51.0)})
    out = LY.office_values(lines, pcs, 10)
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("rate_pm2"), 2).alias("rate"))


@query("m35_public_land_in_catchment", ORACLES["a36_public_land"])
def m35(t):
    """Public land of every catchment (the mart is the operator run for all stations)."""
    return a36(t)


@query("m36_land_ownership", "select 'owner_'||(c_nationkey%4) as dataset, count(*) as n from customer group by 1")
def m36(t):
    """Feature records per public body, loaded as replaceable datasets."""
    path = scratch_path(t.spark, "ownership")
    k = F.col("c_custkey")
    for i in range(4):
        rows = t.customer.filter(F.col("c_nationkey") % 4 == i)
        feats = FT.emit_features(rows, f"owner_{i}", F.col("c_name"), {"nation": F.col("c_nationkey")}, F.concat(F.lit("POINT("), k.cast("string"), F.lit(" 1)")), k)
        TB.replace_dataset(feats, path)
    return t.spark.read.parquet(path).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


