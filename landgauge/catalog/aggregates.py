"""Queries for grouped measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from landgauge.catalog import bindings as B
from landgauge.catalog.geometry import BLOCK_CELLS_SQL, CELL, MOVED_SQL, SITE_CELLS_SQL, block_pieces, block_shapes, rings, site_cover, site_pieces
from landgauge.catalog.joins import BIG, SA, D
from landgauge.catalog.registry import query
from landgauge.operators import aggregates as A
from landgauge.operators import cells as K
from landgauge.operators import overlay as O
from landgauge.operators import spatial as S
from landgauge.operators.ordering import exact_quantiles, first_per, medians
from landgauge.operators.ranking import quantile_breaks


@query(
    "a01_amenity_score",
    SA + f""", c as (select sid, count(*) filter (where kind='gp' and {D}<=4000) gp, count(*) filter (where kind='pharmacy' and {D}<=4000) ph, count(*) filter (where kind='school' and {D}<=4000) sc, count(*) filter (where kind='nursery' and {D}<=4000) nu, count(*) filter (where kind='bus' and {D}<=4000) bus from stations, amenities group by 1)
 select sid, 20*(case when gp>=1 then 1 else 0 end)+20*(case when ph>=1 then 1 else 0 end)+20*(case when sc>=1 then 1 else 0 end)+20*(case when nu>=1 then 1 else 0 end)+least(bus,10)*2e0 as score, bus from c""",
)
def a01(t):
    kinds = (*A.AMENITY_KINDS, "bus")
    counts = S.catchment_totals(B.stations(t), "sid", B.amenities(t), [4000], {k: F.when(F.col("kind") == k, 1).otherwise(0) for k in kinds})
    cols = {k: F.col(f"{k}_4000") for k in kinds}
    return counts.select("sid", A.amenity_score(cols).alias("score"), F.col("bus_4000").alias("bus"))


@query(
    "a02_weighted_mean",
    "select c_nationkey, round(sum(c_acctbal*w) filter (where v is not null)/nullif(sum(w) filter (where v is not null),0),4) as mean from (select c_nationkey, case when c_custkey%4>0 then c_acctbal end as v, c_acctbal, abs(c_acctbal) as w from customer) group by 1",
)
def a02(t):
    v = F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal"))
    return t.customer.groupBy("c_nationkey").agg(F.round(A.weighted_mean(v, F.abs("c_acctbal")), 4).alias("mean"))


@query(
    "a03_exact_percentiles",
    "select l_suppkey, round(quantile_cont(l_extendedprice,0.25),4) as p25, round(quantile_cont(l_extendedprice,0.5),4) as p50, round(quantile_cont(l_extendedprice,0.75),4) as p75, round(quantile_cont(l_extendedprice,0.5) filter (where l_returnflag='R'),4) as p50_r, count(*) as n from lineitem group by 1",
)
def a03(t):
    q = exact_quantiles(t.lineitem, ["l_suppkey"], {"v": F.col("l_extendedprice")}, {"all": ("v", None), "r": ("v", F.col("l_returnflag") == "R")}, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return q.select("l_suppkey", *[F.round(f"all_{p}", 4).alias(p) for p in ("p25", "p50", "p75")], F.round("r_p50", 4).alias("p50_r"), F.col("all_n").alias("n"))


@query(
    "a04_gated_statistic",
    "select o_custkey, count(*) as n, case when count(*)>=5 then round(avg(o_totalprice),4) end as mean_price from orders group by 1",
)
def a04(t):
    g = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("m"))
    return g.select("o_custkey", "n", A.gated(F.round("m", 4), F.col("n"), 5).alias("mean_price"))


@query(
    "a07_area_medians",
    """with s as (select l_suppkey, s_nationkey, case when l_partkey%5>0 and (l_suppkey%11>0 or l_partkey%2=0) then l_extendedprice end as p from lineitem join supplier on s_suppkey=l_suppkey),
 a as (select l_suppkey, any_value(s_nationkey) as nk, count(p) as n, quantile_cont(p,0.5) as med from s group by 1), l as (select s_nationkey as nk, quantile_cont(p,0.5) as lm from s group by 1)
 select l_suppkey, n, round(case when n>=400 then med else lm end,4) as median_price, round(case when n>=400 then med else lm end/94,4) as derived_ppm2, case when n>=400 then 'small_area' else 'district' end as source from a join l using (nk)""",
)
def a07(t):
    known = (F.col("l_partkey") % 5 > 0) & ((F.col("l_suppkey") % 11 > 0) | (F.col("l_partkey") % 2 == 0))
    s = t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").withColumn("p", F.when(known, F.col("l_extendedprice")))
    small = medians(s, ["l_suppkey", "s_nationkey"], {"p": F.col("p")})
    wide = medians(s, ["s_nationkey"], {"d": F.col("p")}).select("s_nationkey", "d_med")
    best = F.when(F.col("p_n") >= 400, F.col("p_med")).otherwise(F.col("d_med"))
    return small.join(wide, "s_nationkey").select(
        "l_suppkey", F.col("p_n").alias("n"), F.round(best, 4).alias("median_price"), F.round(best / 94, 4).alias("derived_ppm2"),
        F.when(F.col("p_n") >= 400, "small_area").otherwise("district").alias("source"),
    )


@query(
    "a08_snap_grid",
    B.ctes(B.AMENITIES_SQL) + "select cast(floor(x/9000) as int) as gx, cast(floor(y/9000) as int) as gy, round(avg(c_acctbal),6) as mean, max(coalesce(case when id%2=0 then c_acctbal+50 end, c_acctbal)) as top, count(*) as n from amenities group by 1,2",
)
def a08(t):
    am = B.amenities(t).withColumn("hi", F.when(F.col("id") % 2 == 0, F.col("c_acctbal") + 50))
    return A.snap_grid(am, "x", "y", "c_acctbal", "hi", 9000.0).withColumn("mean", F.round("mean", 6))


@query(
    "a09_block_best_case",
    B.ctes(B.VENUES_SQL) + "select cast(floor(x/10000) as int) as be, cast(floor(y/10000) as int) as bn, min(p_size) as p_size, max(cap) as cap, round(avg(x),4) as mid_e, round(avg(y),4) as mid_n, count(*) as n_cells from venues group by 1,2",
)
def a09(t):
    out = A.block_best_case(B.venues(t), "x", "y", 10000.0, ["p_size"], ["cap"])
    return out.withColumn("mid_e", F.round("mid_e", 4)).withColumn("mid_n", F.round("mid_n", 4))


GROUPS = {"built": ("built_land",), "green": ("green_space", "green_belt"), "prot": ("sssi", "conservation_area")}


@query(
    "a10_cell_composition",
    B.ctes(B.BLOCKS_SQL, BLOCK_CELLS_SQL)
    + """, g as (select distinct case when kind='built_land' then 'built' when kind in ('green_space','green_belt') then 'green' else 'prot' end as g, cx, cy from block_cells)
 select cast(cx//10 as int) as gx, cast(cy//10 as int) as gy, cast(least(100, count(*) filter (where g='built')) as int) as built_pct, cast(least(100, count(*) filter (where g='green')) as int) as green_pct, cast(least(100, count(*) filter (where g='prot')) as int) as prot_pct from g group by 1,2""",
)
def a10(t):
    return A.cell_composition(block_shapes(t), GROUPS, 1000.0)


@query(
    "a11_catchment_profile",
    B.ctes(B.STATIONS_SQL, B.VENUES_SQL)
    + f""", p as (select sid, id, p_type, cap, {D} as d from stations, venues where {D}<=5000)
 select sid, count(*) as n, sum(cap) as cap, count(*) filter (where d<=1000) as n_1km, count(*) filter (where d<=3000) as n_3km, count(*) filter (where p_type='ECONOMY') as n_economy,
  (list(id order by cap desc, id))[1] as top_id, least(count(*),12) as n_top from p group by 1""",
)
def a11(t):
    """Counts, bands, per-type map and the 12 largest of each origin's catchment."""
    st, ve = B.stations(t).select("sid", "sx", "sy"), B.venues(t)
    wanted = [("n", 1000), ("n", 3000), ("n", 5000), ("cap", 5000)]
    types = S.catchment_sums_by(st, "sid", ve, {"n": F.lit(1), "cap": F.col("cap")}, wanted, ["p_type"])
    sums = types.groupBy("sid").agg(
        F.sum("n_5000").alias("n"), F.sum("cap_5000").alias("cap"), *[F.coalesce(F.sum(f"n_{r}"), F.lit(0)).alias(f"n_{r // 1000}km") for r in (1000, 3000)],
        F.map_from_entries(F.collect_list(F.struct("p_type", "n_5000"))).alias("by_type"),
    )
    tops = S.largest_within(st, "sid", ve, "id", "cap", 5000.0, 12).groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("rk", "id", "cap"))).alias("top"))
    return sums.join(tops, "sid").select(
        "sid", "n", "cap", "n_1km", "n_3km", F.coalesce(F.col("by_type")["ECONOMY"], F.lit(0)).alias("n_economy"),
        F.col("top")[0]["id"].alias("top_id"), F.size("top").cast("bigint").alias("n_top"),
    )


@query("a12_top_groups", "select c_nationkey, count(*) as n from customer where c_acctbal>0 group by 1 order by n desc, c_nationkey limit 15")
def a12(t):
    g = t.customer.filter("c_acctbal > 0").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return A.top_n(g, [], [F.col("n").desc(), F.col("c_nationkey")], 15)


@query(
    "a13_aggregate_titles",
    "select o_custkey%200 as postcode, o_orderpriority as owner, count(*) as titles, count(*) filter (where o_orderkey%3=0) as titles_flat, count(*) filter (where o_orderkey%3>0) as titles_land, min_by('addr '||o_orderkey, o_orderkey) filter (where o_orderkey%3>0) as address, count(*) filter (where o_orderkey%3>0)>0 as has_land from orders group by 1,2",
)
def a13(t):
    k = F.col("o_orderkey")
    titles = t.orders.select((F.col("o_custkey") % 200).alias("postcode"), F.col("o_orderpriority").alias("owner"), (k % 3 == 0).alias("is_flat"), F.concat(F.lit("addr "), k.cast("string")).alias("address"), k.alias("ord"))
    return A.aggregate_titles(titles)


@query(
    "a21_quantile_breaks",
    """with l as (select 'p_size' as layer, cast(p_size as double) as v from part union all select 'p_retailprice', p_retailprice from part), a as (select layer, list(v order by v) as v, count(*) as n, min(v) as low, max(v) as high from l group by 1)
 select layer, n, low, high, v[cast(floor(n/6.0) as int)+1] as break_1, v[cast(floor(2*n/6.0) as int)+1] as break_2, v[cast(floor(3*n/6.0) as int)+1] as break_3, v[cast(floor(4*n/6.0) as int)+1] as break_4, v[cast(floor(5*n/6.0) as int)+1] as break_5, v[cast(floor(0.16*n) as int)+1] as band_low, v[cast(floor(0.84*n) as int)+1] as band_high from a""",
)
def a21(t):
    return quantile_breaks(t.part, ["p_size", "p_retailprice"], 6)


HOTEL_SQL = """h as (select p_partkey as id, p_type as kind, case when p_partkey%2=0 then p_brand end as brand, case when p_partkey%3=0 then p_size*4 end as tagged, case when p_partkey%5>0 then p_retailprice end as area, case when p_partkey%4=0 then p_size%6+1 end as levels from part)"""


def hotels(t):
    k = F.col("p_partkey")
    return t.part.select(
        k.alias("id"), F.col("p_type").alias("kind"), F.when(k % 2 == 0, F.col("p_brand")).alias("brand"), F.when(k % 3 == 0, F.col("p_size") * 4).alias("tagged"),
        F.when(k % 5 > 0, F.col("p_retailprice")).alias("area"), F.when(k % 4 == 0, F.col("p_size") % 6 + 1).alias("levels"),
    )


@query(
    "a22_impute_rooms",
    f"""with {HOTEL_SQL}, tg as (select * from h where tagged between 1 and 2000), b as (select brand, quantile_cont(tagged,0.5) as bm from tg where brand is not null group by 1 having count(*)>=5), k as (select kind, quantile_cont(tagged,0.5) as km from tg group by 1),
 f as (select count(*) n, greatest(0.3,least(1.0,regr_slope(ln(tagged),ln(area*coalesce(levels,3))))) as sl, avg(ln(area*coalesce(levels,3))) mx, avg(ln(tagged)) my from tg where area>0),
 g as (select case when n>=30 then sl else 1.0 end as slope, case when n>=30 then exp(my-sl*mx) else 0.65/30 end as scale from f),
 r as (select id, case when tagged between 1 and 2000 then tagged when bm is not null then cast(round(bm) as int) when area>80 then cast(greatest(5,least(1500,round(scale*pow(area*least(coalesce(levels,3),40),slope)))) as int) else cast(round(coalesce(km,10)) as int) end as rooms,
  case when tagged between 1 and 2000 then 'tagged' when bm is not null then 'brand' when area>80 then 'footprint' else 'typical' end as rooms_src from h left join b using (brand) left join k using (kind), g)
 select id, rooms, rooms_src, rooms*2 as beds from r""",
)
def a22(t):
    return A.impute_rooms(hotels(t)).select("id", "rooms", "rooms_src", "beds")


@query(
    "a23_footprint_fit",
    f"""with {HOTEL_SQL}, f as (select count(*) n, greatest(0.3,least(1.0,regr_slope(ln(tagged),ln(area)))) sl, avg(ln(area)) mx, avg(ln(tagged)) my from h where tagged>0 and area>0)
 select n, round(case when n>=30 then sl else 1.0 end,6) as slope, round(case when n>=30 then exp(my-sl*mx) else 0.65/30 end,6) as scale from f""",
)
def a23(t):
    return A.footprint_fit(hotels(t), "area", "tagged").select("n", F.round("slope", 6).alias("slope"), F.round("scale", 6).alias("scale"))


@query(
    "a24_uprate",
    """with i as (select year(o_orderdate) as y, avg(o_totalprice) as rpi from orders group by 1), l as (select max_by(rpi,y) as now from i)
 select o_orderkey, round(o_totalprice*now/rpi,3) as uprated from orders join i on y=year(o_orderdate), l""",
)
def a24(t):
    o = t.orders.withColumn("yr", F.year("o_orderdate"))
    index = o.groupBy(F.col("yr").alias("year")).agg(F.avg("o_totalprice").alias("rpi"))
    return A.uprate(o, index, "yr", "o_totalprice", "u").select("o_orderkey", F.round("u", 3).alias("uprated"))


@query(
    "a25_consensus",
    """with l as (select o_custkey%50 as zone, o_orderpriority as tier, o_orderstatus as agent, max_by(o_totalprice, (o_orderdate, -o_orderkey)) as rent from orders group by 1,2,3)
 select zone, tier, round(avg(rent),4) as mean_rent, count(*) as n_agents, round(max(rent),2) as top from l group by 1,2""",
)
def a25(t):
    figs = t.orders.select((F.col("o_custkey") % 50).alias("zone"), F.col("o_orderpriority").alias("tier"), F.col("o_orderstatus").alias("agent"), F.col("o_totalprice").alias("rent"), F.col("o_orderdate").alias("score"), F.col("o_orderkey").alias("fig_id"))
    return A.consensus(figs).select("zone", "tier", F.round("mean_rent", 4).alias("mean_rent"), "n_agents", F.round(F.col("figures")[0], 2).alias("top"))


MONTHLY_SQL = """m as (select o_orderpriority as code, cast(date_trunc('month', o_orderdate) as date) as month, avg(o_totalprice) as rent from orders where month(o_orderdate)<>7 group by 1,2)"""


def monthly(t):
    o = t.orders.filter(F.month("o_orderdate") != 7)
    return o.groupBy(F.col("o_orderpriority").alias("code"), F.trunc("o_orderdate", "month").alias("month")).agg(F.avg("o_totalprice").alias("rent"))


@query(
    "a26_pack_series",
    f"""with {MONTHLY_SQL}, s as (select code, min(month) as f, max(month) as l from m group by 1), g as (select code, f, cast(unnest(generate_series(f, l, interval 1 month)) as date) as month from s)
 select code, month, round(rent,4) as rent from g left join m using (code, month)""",
)
def a26(t):
    packed = A.pack_series(monthly(t), ["code"], "month", "rent")
    return A.unpack_series(packed, ["code"], "rent").select("code", "month", F.round("rent", 4).alias("rent"))


@query(
    "a26_growth",
    f"""with {MONTHLY_SQL}, z as (select code, max(month) as l from m group by 1)
 select z.code, case when b.rent>0 then round((a.rent/b.rent-1)*100,1) end as growth_60m from z join m a on a.code=z.code and a.month=l left join m b on b.code=z.code and b.month=cast(l - interval 60 month as date)""",
)
def a26_growth(t):
    packed = A.pack_series(monthly(t), ["code"], "month", "rent")
    return packed.select("code", A.growth_pct(F.col("values"), 60).alias("growth_60m"))


@query(
    "a27_rollup_scores",
    "select c_nationkey, round(sum(w*c_acctbal)/sum(w),4) as overall, round(sum(w*h) filter (where h is not null)/sum(w) filter (where h is not null),4) as health from (select *, case when c_acctbal>0 then c_acctbal else 1 end as w, case when c_custkey%3>0 then c_custkey end as h from customer) group by 1",
)
def a27(t):
    c = t.customer.withColumn("overall", F.col("c_acctbal")).withColumn("health", F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey")))
    out = A.rollup_scores(c, "c_nationkey", ["overall", "health"], "c_acctbal")
    return out.select("c_nationkey", F.round("overall", 4).alias("overall"), F.round("health", 4).alias("health"))


@query("a28_queue_totals", B.ctes(B.VENUES_SQL, B.AREAS_SQL) + "select area_id, sum(cap) as mw, count(*) as n from venues join areas on x>=minx and x<maxx and y>=miny and y<maxy group by 1")
def a28(t):
    inside = S.points_in_polygons(B.venues(t), "id", rings(B.areas(t), "area_id"), "area_id", BIG)
    return inside.join(B.venues(t).select("id", "cap"), "id").groupBy("area_id").agg(F.sum("cap").alias("mw"), F.count(F.lit(1)).alias("n"))


@query(
    "a29_approval_rates",
    """with a as (select o_custkey%100 as area, year(o_orderdate) as yr, case o_orderstatus when 'F' then 'approved' when 'P' then 'refused' else 'pending' end as st from orders)
 select area, yr, count(*) as n, count(*) filter (where st='approved') as approved, count(*) filter (where st='refused') as refused, count(*) filter (where st='pending') as pending,
 case when count(*) filter (where st<>'pending')>=5 then round(100.0*count(*) filter (where st='approved')/count(*) filter (where st<>'pending'),1) end as approval_pct from a group by 1,2""",
)
def a29(t):
    st = F.col("o_orderstatus")
    apps = t.orders.select((F.col("o_custkey") % 100).alias("area"), F.year("o_orderdate").alias("yr"), F.when(st == "F", "approved").when(st == "P", "refused").otherwise("pending").alias("st"))
    return A.approval_rates(apps, ["area", "yr"], "st")


@query(
    "a30_affordability",
    B.ctes(B.SALES_SQL, B.AREAS_SQL, "inc as (select c_nationkey as area_id, avg(abs(c_acctbal)) as income from customer group by 1)")
    + f""", m as (select area_id, count(*) as n, quantile_cont(price,0.5) as med from sales join areas on x>=minx and x<maxx and y>=miny and y<maxy where sold >= date '{B.AS_OF}' - interval 12 month group by 1)
 select area_id, n, cast(round(med) as bigint) as median_price, case when n>=20 then round(med/income,1) end as ratio from m join inc using (area_id)""",
)
def a30(t):
    as_of = F.lit(B.AS_OF).cast("date")
    recent = B.sales(t).filter(F.col("sold") >= F.add_months(as_of, -12))
    spots = recent.select("x", "y").distinct().withColumn("spot", F.concat_ws(",", "x", "y"))
    inside = S.points_in_polygons(spots, "spot", rings(B.areas(t), "area_id"), "area_id", BIG).join(spots, "spot")
    m = medians(recent.join(inside.select("x", "y", "area_id"), ["x", "y"]), ["area_id"], {"p": F.col("price")})
    income = t.customer.groupBy(F.col("c_nationkey").alias("area_id")).agg(F.avg(F.abs("c_acctbal")).alias("income"))
    return m.join(income, "area_id").select("area_id", F.col("p_n").alias("n"), F.round("p_med").cast("bigint").alias("median_price"), A.gated(F.round(F.col("p_med") / F.col("income"), 1), F.col("p_n"), 20).alias("ratio"))


@query(
    "a31_ratio_columns",
    "select c_nationkey, count(*) as total, round(100.0*count(*) filter (where c_mktsegment='BUILDING')/count(*),4) as building_pct, round(100.0*count(*) filter (where c_mktsegment='MACHINERY')/count(*),4) as machinery_pct from customer group by 1",
)
def a31(t):
    return t.customer.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.round(100 * F.count_if(F.col("c_mktsegment") == s) / F.count(F.lit(1)), 4).alias(f"{s.lower()}_pct") for s in ("BUILDING", "MACHINERY")],
    )


@query(
    "a32_housing_need",
    """with r as (select c_custkey as lad, abs(c_acctbal)*20 as stock, 3+c_custkey%10 as ratio, c_custkey%300 as plan_annual from customer), n as (select *, case when ratio<=5 then 1.0 else (ratio-5)/5.0*0.95+1 end as factor from r)
 select lad, round(factor,3) as factor, cast(round(stock*0.008*factor) as bigint) as lhn, round(100.0*plan_annual/nullif(stock*0.008*factor,0),1) as plan_pct, coalesce(100.0*plan_annual/nullif(stock*0.008*factor,0)<=80,false) as below80 from n""",
)
def a32(t):
    factor, need = A.housing_need(F.abs("c_acctbal") * 20, 3 + F.col("c_custkey") % 10)
    pct = 100 * (F.col("c_custkey") % 300) / F.nullif(need, F.lit(0.0))
    return t.customer.select(
        F.col("c_custkey").alias("lad"), F.round(factor, 3).alias("factor"), F.round(need).cast("bigint").alias("lhn"), F.round(pct, 1).alias("plan_pct"), F.coalesce(pct <= A.BELOW_PCT, F.lit(False)).alias("below80")
    )


@query(
    "a33_plan_gap",
    """with p as (select o_custkey as boundary, o_orderkey as plan, (['draft','submitted','examined','adopted'])[cast(o_orderkey%4 as int)+1] as stage, o_orderkey%4 as sr, cast(o_orderdate as date) as adopted, case when o_orderkey%3>0 then cast(floor(o_totalprice) as int) end as required, case when o_orderkey%5>0 then cast(floor(o_totalprice/2) as int) end as allocated, cast(floor(o_totalprice/3) as int) as committed, case when o_orderkey%2=0 then 100 end as windfall, o_orderkey%7>0 as hr from orders),
 q as (select boundary, plan, sr, adopted, case when hr then required end as required, case when hr then allocated end as allocated, case when hr then committed end as committed, case when hr then windfall end as windfall, hr from p),
 b as (select * from q qualify row_number() over (partition by boundary order by (required is not null and allocated is not null and committed is not null) desc, hr desc, sr desc, adopted desc, plan desc)=1),
 e as (select l_orderkey as plan, max_by(l_returnflag, (l_shipdate, l_returnflag)) as last_event from lineitem group by 1)
 select boundary, plan, last_event, case when required is not null then allocated+committed+coalesce(windfall,0) end as supply, case when allocated is not null and required is not null then greatest(0, required-(allocated+committed+coalesce(windfall,0))) end as gap,
 case when required>0 then round(100.0*(allocated+committed+coalesce(windfall,0))/required,1) end as pct_met, round(date_diff('day', adopted, date '2001-01-01')/365.25,1) as plan_age_yrs,
 case when required is not null and allocated is not null and committed is not null then 'has_numbers' when coalesce(required,allocated,committed,windfall) is not null then 'partial_supply' else 'plan_only' end as status from b left join e using (plan)""",
)
def a33(t):
    k = F.col("o_orderkey")
    stages = F.element_at(F.array(*[F.lit(s) for s in A.PLAN_STAGES[1:]]), (k % 4 + 1).cast("int"))
    d = F.to_date("o_orderdate")
    plans = t.orders.select(F.col("o_custkey").alias("boundary"), k.alias("plan"), stages.alias("stage"), d.alias("adopted"), d.alias("period_end"))
    price = F.col("o_totalprice")
    hous = t.orders.filter(k % 7 > 0).select(
        k.alias("plan"), F.lit(True).alias("has_row"), F.when(k % 3 > 0, F.floor(price).cast("int")).alias("required"),
        F.when(k % 5 > 0, F.floor(price / 2).cast("int")).alias("allocated"), F.floor(price / 3).cast("int").alias("committed"), F.when(k % 2 == 0, 100).alias("windfall"),
    )
    events = t.lineitem.select(F.col("l_orderkey").alias("plan"), F.col("l_returnflag").alias("event"), F.col("l_shipdate").alias("event_date"))
    return A.plan_gap(plans, hous, events, F.lit(B.AS_OF).cast("date"))


@query(
    "a34_junction_flow",
    """with e as (select l_partkey as road, l_extendedprice as flow, l_suppkey as node from lineitem union all select l_partkey, l_extendedprice, 100000+l_orderkey from lineitem)
 select node, count(*) as n_links, count(distinct road) as n_roads, round(sum(flow)/2,4) as flow from e group by 1 having count(*)>=3 and count(distinct road)>=2""",
)
def a34(t):
    links = t.lineitem.select(F.col("l_partkey").alias("road"), F.col("l_extendedprice").alias("flow"), F.col("l_suppkey").alias("a"), (100000 + F.col("l_orderkey")).alias("b"))
    return A.junction_flow(links).withColumn("flow", F.round("flow", 4))


@query("a35_latest_per_key", "select o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey, max_by(o_totalprice, (o_orderdate, o_orderkey)) as o_totalprice from orders group by 1")
def a35(t):
    return A.latest_by(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


DISC_SQL = """disc as (select sid, cx, cy, sqrt(pow((cx+0.5)*100-sx,2)+pow((cy+0.5)*100-sy,2)) as d from (select sid, sx, sy, gx.o+cast(floor(sx/100) as int) as cx, gy.o+cast(floor(sy/100) as int) as cy from stations, (select unnest(range(-22,23)) as o) gx, (select unnest(range(-22,23)) as o) gy) where sqrt(pow((cx+0.5)*100-sx,2)+pow((cy+0.5)*100-sy,2))<=2000)"""


@query(
    "a36_public_land",
    B.ctes(B.STATIONS_SQL, B.SITES_SQL, SITE_CELLS_SQL, DISC_SQL)
    + """, h as (select sid, d, site_id, site_id%4 as cls, site_id%5=0 as disputed from disc join site_cells using (cx, cy))
 select sid, count(*) filter (where not disputed)*1e0 as ha, count(*) filter (where not disputed and d<=500)*1e0 as ha_inner, count(distinct site_id) filter (where not disputed) as n, count(*) filter (where not disputed and cls=1)*1e0 as ha_class_1, count(*) filter (where disputed)*1e0 as ha_disputed from h group by 1""",
)
def a36(t):
    """Clipped hectares of public parcels per catchment; disputed parcels reported apart."""
    disc = K.disc_cells(B.stations(t), ["sid"], F.col("sx"), F.col("sy"), 2000, CELL)
    st = B.stations(t).select("sid", "sx", "sy")
    d = F.hypot((F.col("cx") + 0.5) * CELL - F.col("sx"), (F.col("cy") + 0.5) * CELL - F.col("sy"))
    inner = disc.join(st, "sid").withColumn("inner", d <= 500).select("sid", "cx", "cy", "inner")
    held = site_cover(t).withColumn("cls", F.col("site_id") % 4).withColumn("disputed", F.col("site_id") % 5 == 0)
    h = inner.join(held, ["cx", "cy"])
    ok, ha = ~F.col("disputed"), F.col("area") / 1e4

    def total(cond):
        return F.round(F.sum(F.when(cond, ha).otherwise(0.0)), 6)

    return h.groupBy("sid").agg(
        total(ok).alias("ha"), total(ok & F.col("inner")).alias("ha_inner"), F.count_distinct(F.when(ok, F.col("site_id"))).alias("n"),
        total(ok & (F.col("cls") == 1)).alias("ha_class_1"), total(F.col("disputed")).alias("ha_disputed"),
    )


@query(
    "a37_site_summary",
    B.ctes(B.BLOCKS_SQL, B.SITES_SQL, BLOCK_CELLS_SQL, MOVED_SQL)
    + """, c as (select distinct kind, cx*100.0 as x, cy*100.0 as y from block_cells),
 k as (select site_id, kind, sum((least(maxx,x+100)-greatest(minx,x))*(least(maxy,y+100)-greatest(miny,y)))/any_value((maxx-minx)*(maxy-miny)) as share from moved join c on x<maxx and x+100>minx and y<maxy and y+100>miny group by 1,2),
 n as (select site_id, kind, count(*) as n_blocks from moved s join blocks b on s.minx<b.maxx and b.minx<s.maxx and s.miny<b.maxy and b.miny<s.maxy group by 1,2)
 select site_id, kind, round(100.0*share,4) as pct, n_blocks from k join n using (site_id, kind) where 100.0*share>=0.5""",
)
def a37(t):
    """Percent of each site under each constraint kind (union, at least 0.5 %), and how many constraints of the kind meet it."""
    sites = site_pieces(t)
    size = O.areas(sites, ["site_id"]).withColumnRenamed("area", "size")
    share = O.covered_by(sites, ["site_id"], block_pieces(t, "kind"), ["kind"], 250.0, apart=True)
    count = O.overlap_areas(sites, ["site_id"], block_pieces(t, "kind", "block_id"), ["kind", "block_id"], 250.0).groupBy("site_id", "kind").agg(F.count(F.lit(1)).alias("n_blocks"))
    pct = 100 * F.col("area") / F.col("size")
    return share.join(size, "site_id").filter(pct >= 0.5).select("site_id", "kind", F.round(pct, 4).alias("pct")).join(count, ["site_id", "kind"])


@query(
    "a39_study_tables",
    """with v as (select p_type as typology, p_brand as tier, p_size*200 as cap, p_retailprice as cost, 1800+cast(p_partkey%220 as int) as yr from part where p_size*200>=1000)
 select typology, tier, grouping(typology) as g_typology, grouping(tier) as g_tier, count(*) as n, sum(cap) as seats, round(sum(cost*cap)/sum(cap),4) as cost_per_seat, count(*) filter (where yr>=1990) as modern from v group by grouping sets ((typology),(tier),())""",
)
def a39(t):
    """Study tables as one grouping-sets pass."""
    v = t.part.select(F.col("p_type").alias("typology"), F.col("p_brand").alias("tier"), (F.col("p_size") * 200).alias("cap"), F.col("p_retailprice").alias("cost"), (1800 + F.col("p_partkey") % 220).alias("yr")).filter("cap >= 1000")
    return v.groupingSets([["typology"], ["tier"], []], "typology", "tier").agg(
        F.grouping("typology").cast("bigint").alias("g_typology"), F.grouping("tier").cast("bigint").alias("g_tier"),
        F.count(F.lit(1)).alias("n"), F.sum("cap").alias("seats"), F.round(F.sum(F.col("cost") * F.col("cap")) / F.sum("cap"), 4).alias("cost_per_seat"), F.count_if(F.col("yr") >= 1990).alias("modern"),
    )


@query(
    "a39_decade_histogram",
    "select p_type as typology, cast(floor((1800+p_partkey%220)/10)*10 as int) as decade, count(*) as n, round(quantile_cont(p_size*200,0.5),2) as median_cap from part group by 1,2",
)
def a39_decades(t):
    v = t.part.select(F.col("p_type").alias("typology"), (F.floor((1800 + F.col("p_partkey") % 220) / 10) * 10).cast("int").alias("decade"), (F.col("p_size") * 200).alias("cap"))
    m = medians(v, ["typology", "decade"], {"c": F.col("cap")})
    return m.select("typology", "decade", F.col("c_n").alias("n"), F.round("c_med", 2).alias("median_cap"))


@query(
    "a40_register_summary",
    "select c_nationkey, count(*) as n, count(*) filter (where c_custkey%3=1) as n_public, sum(c_custkey%50) as min_dwellings, sum(c_custkey%50+10) as max_dwellings, round(sum(c_acctbal/100),4) as hectares from customer group by 1",
)
def a40(t):
    k = F.col("c_custkey")
    return t.customer.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(k % 3 == 1).alias("n_public"), F.sum(k % 50).alias("min_dwellings"), F.sum(k % 50 + 10).alias("max_dwellings"), F.round(F.sum(F.col("c_acctbal") / 100), 4).alias("hectares")
    )


@query(
    "a41_headroom",
    """with d as (select 'a' as dno, p_partkey as id, case when p_partkey%3=0 then cast(p_size as double) else 2.0*p_size+10-greatest(p_size,p_size+10) end - p_retailprice/100 as headroom from part where p_partkey%6<>2 and p_partkey%2=0),
 e as (select 'b' as dno, s_suppkey as id, s_acctbal/100 as headroom from supplier) select dno, id, round(headroom,4) as headroom from (select * from d union all select * from e)""",
)
def a41(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    raw = F.when(k % 3 == 0, s.cast("string")).otherwise(F.concat_ws(", ", s.cast("string"), F.lit("x"), (s + 10).cast("string")))
    a = t.part.filter(k % 2 == 0).select(F.lit("a").alias("dno"), k.alias("id"), raw.alias("ratings"), (F.col("p_retailprice") / 100).alias("demand"), F.when(k % 6 == 2, "HOT").alias("cls"))
    first = A.headroom(a, "ratings", "demand", "cls").select("dno", "id", "headroom")
    second = t.supplier.select(F.lit("b").alias("dno"), F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("headroom"))
    return first.unionByName(second).withColumn("headroom", F.round("headroom", 4))


@query(
    "a42_population_reach",
    SA + f"select sid, round(sum(case when {D}<=800 then abs(c_acctbal) else 0 end),2) as pop_800, round(sum(case when {D}<=1500 then abs(c_acctbal) else 0 end),2) as pop_1500, round(sum(case when {D}<=3000 then abs(c_acctbal) else 0 end),2) as pop_3000 from stations, amenities group by 1",
)
def a42(t):
    out = S.catchment_totals(B.stations(t), "sid", B.amenities(t), [800, 1500, 3000], {"pop": F.abs("c_acctbal")})
    return out.select("sid", *[F.round(f"pop_{r}", 2).alias(f"pop_{r}") for r in (800, 1500, 3000)])


@query(
    "a43_origin_metrics",
    B.ctes(B.STATIONS_SQL, B.AMENITIES_SQL, B.VENUES_SQL)
    + f""", a as (select sid, count(*) filter (where kind='school' and {D}<=1500) as schools_1500, count(*) filter (where {D}<=5000) as n_5000, coalesce(round(sum(c_acctbal) filter (where {D}<=10000),2),0) as bal_10000 from stations, amenities group by 1),
 v as (select sid, coalesce(sum(cap) filter (where {D}<=3000),0) as cap_3000, count(*) filter (where {D}<=600) as others_600 from stations, venues group by 1) select * from a join v using (sid)""",
)
def a43(t):
    st = B.stations(t).select("sid", "sx", "sy")
    am = S.catchment_totals(st, "sid", B.amenities(t), [1500, 5000, 10000], {"schools": F.when(F.col("kind") == "school", 1).otherwise(0), "n": F.lit(1), "bal": F.col("c_acctbal")})
    ve = S.catchment_totals(st, "sid", B.venues(t), [600, 3000], {"cap": F.col("cap"), "others": F.lit(1)})
    return am.join(ve, "sid").select("sid", "schools_1500", "n_5000", F.round("bal_10000", 2).alias("bal_10000"), "cap_3000", "others_600")


@query(
    "a44_latest_populated",
    """select c_custkey, 'y2021' as period, c_acctbal+1 as value from customer where c_custkey%2=0""",
)
def a44(t):
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    wide = t.customer.select("c_custkey", b.alias("y2020"), F.when(k % 2 == 0, b + 1).alias("y2021"), F.when(k < 20, b + 2).alias("y2022"))
    return A.latest_populated(wide, "c_custkey", ["y2020", "y2021", "y2022"], 50)


@query(
    "g20_slope_blocks",
    """with g as (select (o_orderkey%60)*50.0 as x, (o_orderkey//60)*50.0 as y, o_totalprice/10000 as z from orders), l as (select x, y, z, lead(z) over (partition by y order by x) nx, lag(z) over (partition by y order by x) px, lead(z) over (partition by x order by y) ny, lag(z) over (partition by x order by y) py from g),
 s as (select x, y, degrees(atan(sqrt(pow((nx-px)/100,2)+pow((ny-py)/100,2)))) as s from l)
 select cast(floor(x/1000) as int) as bx, cast(floor(y/1000) as int) as by, round(avg(s),6) as mean_slope, round(max(s),6) as max_slope, count(s) as n_valid from s group by 1,2 having count(s)>=200""",
)
def g20(t):
    k = F.col("o_orderkey")
    grid = t.orders.select(((k % 60) * 50.0).alias("x"), (F.floor(k / 60) * 50.0).alias("y"), (F.col("o_totalprice") / 10000).alias("z"))
    out = A.slope_blocks(grid, 50.0, 1000.0)
    return out.withColumn("mean_slope", F.round("mean_slope", 6)).withColumn("max_slope", F.round("max_slope", 6))
