"""Queries for filters, gates, timetable measures and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from landgauge.catalog import bindings as B
from landgauge.catalog.clean import pick, sql_pick
from landgauge.catalog.registry import query
from landgauge.operators import filters as P
from landgauge.operators import gates as GT
from landgauge.operators import timetable as TT
from landgauge.operators.aggregates import top_n
from landgauge.operators.ordering import first_per

# ---- filters ---------------------------------------------------------------


@query(
    "f01_in_bbox",
    B.ctes(B.SITES_SQL) + """, h as (select *, (maxx-minx)*(maxy-miny) as m2 from sites where minx<=60000 and maxx>=20000 and miny<=60000 and maxy>=20000),
 k as (select * from h qualify row_number() over (partition by p_type order by m2 desc, site_id)<=20) select site_id, p_type, m2 from k order by m2 desc, site_id limit 70""",
)
def f01(t):
    s = B.sites(t).withColumn("m2", (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")))
    return P.in_bbox(s, (20000, 20000, 60000, 60000), "p_type", "m2", "site_id", 20, 70).select("site_id", "p_type", "m2")


@query("f02_prop_range", "select event_id from events where coalesce(try_cast(json_extract_string(props,'$.k') as double)>=20,false) and (json_extract_string(props,'$.z') is null) and try_cast(json_extract_string(props,'$.k') as double)<80")
def f02(t):
    p = F.col("props")
    return t.events.filter(P.prop_range(p, "k", 20, 80) & P.prop_range(p, "z", None, 5)).select("event_id")


@query("f03_optional_filters", "select c_custkey from customer where c_mktsegment in ('BUILDING','MACHINERY') and c_custkey%50>=10 and c_custkey%3=1")
def f03(t):
    k = F.col("c_custkey")
    df = t.customer.select("c_custkey", F.col("c_mktsegment").alias("kind"), (k % 50).alias("max_dwellings"), F.lit(0).alias("min_dwellings"), (k % 3 == 1).alias("is_public"), F.lit(True).alias("deliverable"))
    return P.sites_filter(df, ["BUILDING", "MACHINERY"], 10, public_only=True).select("c_custkey")


@query(
    "f04_clean_sales",
    f"""select distinct l_orderkey||'-'||l_linenumber as sale_id from lineitem where l_returnflag='A' and cast(l_shipdate as date)>=date '{B.AS_OF}' - interval 36 month and l_suppkey%9>0 and l_partkey%10>0""",
)
def f04(t):
    df = t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sale_id"), F.col("l_returnflag").alias("category"), F.to_date("l_shipdate").alias("sold"),
        F.when(F.col("l_suppkey") % 9 > 0, "AB1 2CD").alias("postcode"),
        F.when(F.col("l_partkey") % 10 > 0, F.round("l_extendedprice").cast("bigint").cast("string")).otherwise("n/a").alias("price_text"),
    )
    return P.clean_sales(df, 36, F.lit(B.AS_OF).cast("date")).select("sale_id")


@query("f05_plausible", "select l_returnflag, count(*) as n from lineitem where l_quantity between 15 and 600 and l_extendedprice/l_quantity between 300 and 30000 group by 1")
def f05(t):
    df = t.lineitem.select("l_returnflag", F.col("l_quantity").alias("m2"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("ppm2"))
    kept = P.plausible(df, {k: P.BOUNDS[k] for k in ("m2", "ppm2")})
    return P.require_rows(kept, 10, "sales").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f06_active_services",
    """select c_custkey as service_id from customer where (c_custkey%7=2 and c_custkey%10>1 and c_custkey%11<>5) or (c_custkey%13=4 and c_custkey%11<>5)""",
)
def f06(t):
    """Calendar flags on the first Wednesday on or after 1 June 1998, with exceptions."""
    k = F.col("c_custkey")
    day = P.pick_day(F.lit("1998-06-01").cast("date"), "Wed")
    cal = t.customer.select(
        k.alias("service_id"),
        *[(k % 7 == i).cast("int").alias(d) for i, d in enumerate(("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"))],
        F.when(k % 10 > 1, F.lit("1998-01-01")).otherwise("1999-01-01").cast("date").alias("start_date"), F.lit("2000-01-01").cast("date").alias("end_date"),
    )
    exc = t.customer.select(k.alias("service_id"), F.when(k % 11 == 5, 2).when(k % 13 == 4, 1).otherwise(0).alias("exception_type"), F.lit("1998-06-03").cast("date").alias("date"))
    return P.active_services(cal, exc, day)


@query(
    "f07_resolve_schedules",
    """with s as (select o_custkey as uid, o_orderkey as ord, (['P','N','O','C','P','P'])[cast(o_orderkey%6 as int)+1] as stp, o_orderkey%7>0 as pass from orders where o_orderdate<=timestamp '1998-06-01')
 select uid, ord, stp from (select * from s qualify row_number() over (partition by uid order by case stp when 'C' then 3 when 'N' then 2 when 'O' then 1 else 0 end desc, ord desc)=1) where stp<>'C' and pass""",
)
def f07(t):
    k = F.col("o_orderkey")
    df = t.orders.select(F.col("o_custkey").alias("uid"), k.alias("ord"), pick("o_orderkey", ["P", "N", "O", "C", "P", "P"]).alias("stp"), (k % 7 > 0).alias("passenger"), F.to_date("o_orderdate").alias("runs_from"), F.lit("2010-01-01").cast("date").alias("runs_to"))
    return P.resolve_schedules(df, F.lit("1998-06-01").cast("date")).select("uid", "ord", "stp")


def grid(t):
    k = F.col("o_orderkey")
    cols = {"built": 23, "transport": 41, "water": 37, "protected": 11, "heritage": 13, "green_belt": 53, "farmland": 47}
    return t.orders.select(
        k.alias("cell"), F.col("o_custkey").alias("lad"), *[(k % m).alias(f"{n}_pct") for n, m in cols.items()], (k % 19 - 1).alias("flood3_pct"), (k % 17 - 1).alias("flood2_pct"),
        (k % 2).alias("aqma"), (k % 70).alias("slope10"), (k % 91).alias("d_sub132"), F.when(k % 3 == 0, 255).otherwise(k % 83).alias("d_dno20"), (k % 29).alias("gsp_mw"), (k % 149).alias("d_set20"), (k % 61).alias("d_heat"),
    )


@query(
    "f08_sift_grid",
    """select 'default' as preset, count(*) as n from orders k where o_orderkey%23<=10 and o_orderkey%41<=20 and o_orderkey%37<=20 and o_orderkey%11<=5 and greatest(o_orderkey%19-1,0)<=10 and o_orderkey%70<=50 and o_orderkey%91<=50
 union all select 'strict', count(*) from orders where o_orderkey%23<=5 and o_orderkey%41<=20 and o_orderkey%37<=20 and o_orderkey%11<=5 and greatest(o_orderkey%19-1,0)<=10 and o_orderkey%53<=25 and o_orderkey%2=0 and o_orderkey%70<=50 and (case when o_orderkey%3=0 then 0 else o_orderkey%83 end)<=50 and o_orderkey%29<=20 and o_orderkey%149<=100""",
)
def f08(t):
    strict = {"built_max": 5, "ex_green_belt": True, "ex_air": True, "power": "d_dno20", "avoid_queue": True, "use_settlement": True}
    out = [P.sift_grid(grid(t), p).agg(F.lit(n).alias("preset"), F.count(F.lit(1)).alias("n")) for n, p in (("default", {}), ("strict", strict))]
    return out[0].unionByName(out[1])


PTAL_PICK = ["0", "1a", "1b", "2", "3", "4", "5", "6a", "6b", None]
CAND_SQL = f"""cand as (select p_partkey as id, {sql_pick('p_partkey', ['register', 'osm_brownfield', 'osm_industrial', 'green_space', 'osm_retail', 'grey_belt'])} as src,
 case when p_size%5=0 then 'construction' when p_size%7=0 then 'Cemetery' else 'other' end as subtype, case when p_size%11=0 then 'Started' end as permission, p_size/20.0 as area_ha,
 {sql_pick('(p_partkey//3)', PTAL_PICK)} as ptal, case when (p_partkey//3)%10<9 then (p_partkey%40)/10.0 end as ptal_ai, p_partkey%45 as z1_min, case when p_partkey%6>0 then p_partkey%101 end as conn_pt, p_retailprice*2 as resi_rent,
 p_partkey%17=0 as in_sil, p_partkey%23=0 as in_mol, p_partkey%19=0 as flood3, case when p_partkey%29=0 then 1 else 0 end as listed_n, case when p_partkey%31=0 then 'Metropolitan' end as sinc_grade, p_partkey%3=0 as in_oa, p_partkey%5=0 as public_land, p_brand as borough from part)"""


def candidates(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    df = t.part.withColumn("third", F.floor(k / 3))
    return df.select(
        k.alias("id"), pick("p_partkey", ["register", "osm_brownfield", "osm_industrial", "green_space", "osm_retail", "grey_belt"]).alias("src"),
        F.when(s % 5 == 0, "construction").when(s % 7 == 0, "Cemetery").otherwise("other").alias("subtype"), F.when(s % 11 == 0, "Started").alias("permission"),
        (s / 20.0).alias("area_ha"), pick("third", PTAL_PICK).alias("ptal"), F.when(F.col("third") % 10 < 9, (k % 40) / 10.0).alias("ptal_ai"), (k % 45).alias("z1_min"), F.when(k % 6 > 0, k % 101).alias("conn_pt"), (F.col("p_retailprice") * 2).alias("resi_rent"),
        (k % 17 == 0).alias("in_sil"), (k % 23 == 0).alias("in_mol"), (k % 19 == 0).alias("flood3"), F.when(k % 29 == 0, 1).otherwise(0).alias("listed_n"),
        F.when(k % 31 == 0, "Metropolitan").alias("sinc_grade"), (k % 3 == 0).alias("in_oa"), (k % 5 == 0).alias("public_land"), F.col("p_brand").alias("borough"),
    )


GATES = [GT.gate("land", types=list(GT.LAND_TYPES)), GT.gate("ptal", "filter", value="2", keep_missing=True), GT.gate("z1", "filter", value=35), GT.gate("conn", "score"), GT.gate("resi", "score"), GT.gate("constraints", "filter")]
LAND_OK = "area_ha>=0.1 and not (src='green_space' and subtype='Cemetery') and not ((src='osm_brownfield' and subtype='construction') or (src='register' and coalesce(permission,'')='Started'))"
PTAL_OK = "(ptal is null or ptal not in ('0','1a','1b'))"
CON_OK = "not in_sil and not in_mol and sinc_grade is null and not flood3 and listed_n=0"


@query(
    "f09_gate_funnel",
    f"""with {CAND_SQL}, g as (select *, {LAND_OK} as a, {PTAL_OK} as b, z1_min<=35 as c, {CON_OK} as d from cand),
 x as (select count(*) n, count(*) filter (where a) na, count(*) filter (where a and b) nb, count(*) filter (where a and b and c) nc, count(*) filter (where a and b and c and d) nd from g)
 select 1 as step, 'land' as gate, n as before, na as after from x union all select 2, 'ptal', na, nb from x union all select 3, 'z1', nb, nc from x union all select 4, 'constraints', nc, nd from x""",
)
def f09(t):
    return GT.run_gates(candidates(t), "id", GATES)[1]


def mid_sql(col: str, name: str, desc: bool) -> str:
    m = f"((rank() over (order by {col})-1)+count(*) over (partition by {col})/2.0)/count({col}) over ()"
    return f"case when {col} is not null then {'1-' if desc else ''}{m} end as {name}"


@query(
    "f09_gate_survivors",
    f"""with {CAND_SQL}, r as (select *, {mid_sql('ptal_ai', 'p0', False)}, {mid_sql('z1_min', 'p1', True)}, {mid_sql('conn_pt', 'p2', False)}, {mid_sql('resi_rent', 'p3', False)} from cand)
 select id, cast(round(100*(4*coalesce(p0,0)+3*p1+2*coalesce(p2,0)+p3)/(4+case when p0 is null then 0 else 4 end+case when p2 is null then 0 else 2 end)) as int) as score from r where {LAND_OK} and {PTAL_OK} and z1_min<=35 and {CON_OK}""",
)
def f09_survivors(t):
    return GT.run_gates(candidates(t), "id", GATES)[0].select("id", "score")


@query(
    "f10_exclusions_and_policy",
    f"""with {CAND_SQL} select id, {CON_OK} as constraints_ok, in_oa or public_land as policy_ok, borough in ('Brand#1','Brand#2') as borough_ok, case when ptal is null then false else ptal in ('4','5','6a','6b') end as ptal_ok from cand""",
)
def f10(t):
    return candidates(t).select(
        "id", GT.gate_constraints(GT.DEFAULT_EXCLUDE).alias("constraints_ok"), GT.gate_policy(("in_oa", "public_land")).alias("policy_ok"),
        GT.gate_borough(("Brand#1", "Brand#2")).alias("borough_ok"), GT.gate_ordinal(F.col("ptal"), "4", False).alias("ptal_ok"),
    )


@query(
    "f11_presets",
    f"""with {CAND_SQL} select 'broad' as preset, count(*) as n from cand where area_ha>=0.25 and {LAND_OK} and not in_mol and sinc_grade is null and not flood3
 union all select 'balanced', count(*) from cand where src<>'green_space' and {LAND_OK} and ptal in ('4','5','6a','6b') and z1_min<=30 and {CON_OK}""",
)
def f11(t):
    """Filter gates of two presets (score gates do not change the count)."""
    out = []
    for name in ("broad", "balanced"):
        cuts = [GT.passes(g) for g in GT.PRESETS[name] if g.mode == "filter"]
        out.append(candidates(t).filter(P.all_of(cuts)).agg(F.lit(name).alias("preset"), F.count(F.lit(1)).alias("n")))
    return out[0].unionByName(out[1])


@query(
    "f12_with_distance",
    B.ctes(B.VENUES_SQL) + "select id, round(sqrt(pow(x-50000,2)+pow(y-50000,2)),4) as dist, case when sqrt(pow(x-50000,2)+pow(y-50000,2))<=10000 then 10000.0 when sqrt(pow(x-50000,2)+pow(y-50000,2))<=30000 then 30000.0 end::double as band from venues",
)
def f12(t):
    return P.with_distance(B.venues(t), 50000.0, 50000.0, [10000, 30000]).select("id", F.round("dist", 4).alias("dist"), "band")


TOKENS = ["Premier League", "Women's Premier League", "FA Cup, Premier League", None, "League One"]


@query("f13_token_in", "select p_partkey, p_partkey%5 in (0,2) as in_premier from part")
def f13(t):
    return t.part.select("p_partkey", P.token_in(pick("p_partkey", TOKENS), "Premier League").alias("in_premier"))


@query("f14_study_filter", "select p_partkey from part where p_size*200>=2000 and p_type in ('ECONOMY','SMALL') and 1900+p_partkey%120>=1990")
def f14(t):
    df = t.part.select("p_partkey", (F.col("p_size") * 200).alias("capacity"), F.col("p_type").alias("sport"), F.lit("E").alias("nation"), (1900 + F.col("p_partkey") % 120).alias("opened"))
    return P.study_filter(df, 2000, ["ECONOMY", "SMALL"], "E", 1990).select("p_partkey")


# ---- timetable -------------------------------------------------------------

CALLS = B.ctes(B.CALLS_SQL)


@query(
    "a14_stop_frequency",
    CALLS + "select stop, trip%50 as zone, count(*) as trips_day, count(*) filter (where hour between 7 and 18) as deps_day, round(count(*) filter (where hour between 7 and 18)/12.0,2) as per_hour, array_to_string(list_sort(list(distinct 'R'||lpad(cast(trip%30 as varchar),2,'0')))[1:10],'|') as routes from calls group by 1,2",
)
def a14(t):
    calls = B.calls(t).withColumn("zone", F.col("trip") % 50).withColumn("route", F.concat(F.lit("R"), F.lpad((F.col("trip") % 30).cast("string"), 2, "0")))
    return TT.stop_frequency(calls, "route", ("stop", "zone")).withColumn("routes", F.array_join("routes", "|"))


@query("a14_expand_frequencies", "select c_custkey as trip, unnest(range(300+c_custkey%100, 300+c_custkey%100+90, 10+c_custkey%7)) as minute from customer")
def a14_freq(t):
    k = F.col("c_custkey")
    return TT.expand_frequencies(t.customer.select(k.alias("trip"), (300 + k % 100).alias("start"), (390 + k % 100).alias("end"), (10 + k % 7).alias("headway")))


@query(
    "a15_link_load",
    CALLS + ", p as (select trip, stop, lead(stop) over (partition by trip order by seq) as nxt from calls) select least(stop,nxt) as lo, greatest(stop,nxt) as hi, count(*) as trips, count(distinct trip) as n_trips from p where nxt is not null and nxt<>stop group by 1,2",
)
def a15(t):
    return TT.link_load(B.calls(t))


TRIP_STOPS = "s as (select trip, stop, min(seq) as f, max(seq) as l, min_by(minute, seq) as minute from calls group by 1,2)"


@query(
    "a16_station_connectivity",
    B.ctes(B.CALLS_SQL, TRIP_STOPS)
    + """, d as (select distinct a.stop, b.stop as dest from s a join s b using (trip) where a.stop<>b.stop and b.l>a.f), r as (select stop, count(*) as destinations, count(*) filter (where dest in ('purchase','error')) as key_cities from d group by 1)
 select stop, count(*) as departures, count(*) filter (where hour between 7 and 9) as peak, min(minute) as first_dep, max(minute) as last_dep, coalesce(any_value(destinations),0) as destinations, coalesce(any_value(key_cities),0) as key_cities from calls left join r using (stop) group by 1""",
)
def a16(t):
    return TT.station_connectivity(B.calls(t), ("purchase", "error"))


HOURS = "h as (select trip, unnest(range(7,19)) as hour from (select distinct trip from calls)), c as (select h.trip, h.hour, count(calls.seq) as n from h left join calls on calls.trip=h.trip and calls.hour=h.hour group by 1,2)"


@query("a17_sustained_tph", B.ctes(B.CALLS_SQL, HOURS) + "select trip, list_sort(list(n))[2] as sustained, max(n) as busiest from c group by 1")
def a17(t):
    return TT.sustained_tph(B.calls(t), ["trip"], 1)


@query(
    "a18_directional_tph",
    CALLS + """, b as (select stop, trip%20 as z, hour, radians(value*7) as b, seq from calls), x as (select stop, z, atan2(sum(sin(2*b)),sum(cos(2*b)))/2 as ax from b group by 1,2), s as (select b.*, cos(b-ax)>=0 as front from b join x using (stop, z)),
 g as (select stop, z, unnest(range(7,19)) as hour from x), c as (select g.stop, g.z, g.hour, count(s.seq) as n, count(s.seq) filter (where front) as a, count(s.seq) filter (where not front) as b from g left join s on s.stop=g.stop and s.z=g.z and s.hour=g.hour group by 1,2,3),
 k as (select stop, z, list_sort(list(n))[2] as sustained, list_sort(list(a))[2] as a, list_sort(list(b))[2] as b from c group by 1,2)
 select stop, z, sustained, greatest(a,b) as best_dir, least(a,b) as worst_dir, sustained>=4 or greatest(a,b)>=2 as meets_frequency from k""",
)
def a18(t):
    return TT.directional_tph(B.calls(t).withColumn("z", F.col("trip") % 20), ["stop", "z"], F.col("value") * 7)


@query(
    "a19_busiest_window",
    CALLS + """, m as (select trip, minute, count(*) as n from calls group by 1,2), w as (select trip, minute, sum(n) over (partition by trip order by minute range between current row and 59 following) as k from m)
 select trip, cast(max(k) as bigint) as busiest, min_by(minute, (-k, minute)) as starts_at from w group by 1""",
)
def a19(t):
    return TT.busiest_window(B.calls(t), ["trip"], 59)


@query(
    "a20_station_links",
    B.ctes(B.CALLS_SQL, TRIP_STOPS)
    + """, p as (select a.stop, b.stop as dest, trip, case when b.minute<a.minute then b.minute-a.minute+1440 else b.minute-a.minute end as m from s a join s b using (trip) where a.stop<>b.stop and b.l>a.f),
 k as (select * from p where m<=600), d as (select stop, dest, quantile_cont(m,0.5) as minutes from k group by 1,2)
 select stop, dest, count(*) as trains_day, any_value(minutes) as minutes from k join d using (stop, dest) group by 1,2""",
)
def a20(t):
    return TT.station_links(B.calls(t))


# ---- order, limits, set operators ------------------------------------------


@query("o01_order_and_limit", "select o_orderkey, o_totalprice from orders order by case when o_orderkey%9>0 then o_totalprice end desc nulls last, o_orderkey limit 100")
def o01(t):
    v = F.when(F.col("o_orderkey") % 9 > 0, F.col("o_totalprice"))
    return top_n(t.orders, [], [v.desc_nulls_last(), F.col("o_orderkey")], 100).select("o_orderkey", "o_totalprice")


@query("o02_two_level_top_k", "select o_custkey, o_orderkey, o_totalprice from (select * from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)<=2) order by o_totalprice desc, o_orderkey limit 200")
def o02(t):
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    return top_n(top_n(t.orders, ["o_custkey"], order, 2), [], order, 200).select("o_custkey", "o_orderkey", "o_totalprice")


@query("o03_ordered_sample", "select l_suppkey, l_orderkey, l_linenumber, l_partkey from lineitem qualify row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey)<=40")
def o03(t):
    return first_per(t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"), ["l_suppkey"], [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey")], 40)


@query(
    "o04_union_sources",
    "select 'customer' as src, c_custkey as id, c_name as name, c_mktsegment as kind, null::varchar as brand from customer union all select 'supplier', s_suppkey, s_name, null, null from supplier union all select 'part', p_partkey, p_name, p_type, p_brand from part",
)
def o04(t):
    a = t.customer.select(F.lit("customer").alias("src"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"))
    b = t.supplier.select(F.lit("supplier").alias("src"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = t.part.select(F.lit("part").alias("src"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


@query("o05_distinct_union", "select l_partkey as node from lineitem union select l_suppkey from lineitem")
def o05(t):
    return t.lineitem.select(F.col("l_partkey").alias("node")).union(t.lineitem.select("l_suppkey")).distinct()


@query("o06_except", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus='P')")
def o06(t):
    return t.customer.select("c_custkey").join(t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("o07_intersect", "select o_custkey from orders where o_orderstatus='P' intersect select o_custkey from orders where o_orderstatus='O'")
def o07(t):
    return t.orders.filter("o_orderstatus = 'P'").select("o_custkey").intersect(t.orders.filter("o_orderstatus = 'O'").select("o_custkey"))
