"""Queries for ranks, percentiles and composite indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from landgauge.catalog.registry import query
from landgauge.operators import ranking as R
from landgauge.operators.ordering import first_per, next_rows, row_numbers, running_total


@query(
    "w01_percent_rank",
    """select o_orderkey, round(percent_rank() over (order by o_totalprice)*1000)/10.0 as pct,
 round(percent_rank() over (partition by o_orderstatus order by o_totalprice desc)*1000)/10.0 as pct_in_status from orders""",
)
def w01(t):
    df = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    df = R.pct_rank(df, "o_totalprice", "p1")
    df = R.pct_rank(df, "o_totalprice", "p2", ["o_orderstatus"], desc=True)
    return df.select(
        "o_orderkey", (F.round(F.col("p1") * 1000) / 10.0).alias("pct"), (F.round(F.col("p2") * 1000) / 10.0).alias("pct_in_status")
    )


@query(
    "w02_average_rank",
    """select l_orderkey, l_linenumber, l_partkey, round((rank() over (order by l_quantity)+(count(*) over (partition by l_quantity)-1)/2.0)/count(*) over ()*100,4) as pct from lineitem""",
)
def w02(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    out = R.avg_rank_pct(df, "l_quantity", "p")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("p") * 100, 4).alias("pct"))


@query(
    "w03_mid_rank",
    """select p_partkey, round(1-((rank() over (order by p_size)-1)+count(*) over (partition by p_size)/2.0)/count(*) over (),6) as pct_best from part""",
)
def w03(t):
    return R.mid_rank_pct(t.part.select("p_partkey", "p_size"), "p_size", "p", -1).select(
        "p_partkey", F.round("p", 6).alias("pct_best")
    )


@query(
    "w04_ecdf",
    "select c_custkey, round(cume_dist() over (partition by c_mktsegment order by c_acctbal),6) as share from customer",
)
def w04(t):
    df = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    return R.ecdf(df, "c_acctbal", "p", ["c_mktsegment"]).select("c_custkey", F.round("p", 6).alias("share"))


@query(
    "w05_ordinal_percentile",
    "select p_partkey, round((row_number() over (order by p_size, p_partkey)-1)/cast(count(*) over () as double),6) as pct from part",
)
def w05(t):
    return R.ordinal_pct(t.part.select("p_partkey", "p_size"), "p_size", "p_partkey", "p").select(
        "p_partkey", F.round("p", 6).alias("pct")
    )


@query(
    "w06_rank_to_percentile",
    """with r as (select s_suppkey, row_number() over (order by s_acctbal, s_suppkey) as r, count(*) over () as n from supplier)
 select s_suppkey, r as published_rank, round((1-(r-1)/cast(n-1 as double))*100,4) as pctile from r""",
)
def w06(t):
    ranked = row_numbers(t.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey", (), "r")
    return ranked.select(
        "s_suppkey", F.col("r").alias("published_rank"), F.round(R.rank_to_pctile(F.col("r"), F.col("n_total")), 4).alias("pctile")
    )


@query(
    "w07_rank_top",
    """with g as (select n_nationkey, n_name, round(sum(c_acctbal),2) as gva from nation join customer on c_nationkey=n_nationkey where n_regionkey<4 group by 1,2)
 select n_nationkey, n_name, gva, row_number() over (order by gva desc, n_nationkey) as rank, row_number() over (order by gva desc, n_nationkey)<=8 as in_top from g""",
)
def w07(t):
    gva = (
        t.nation.filter("n_regionkey < 4")
        .join(t.customer.groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("gva")), F.col("n_nationkey") == F.col("c_nationkey"))
        .select("n_nationkey", "n_name", F.round("gva", 2).alias("gva"))
    )
    return R.rank_top(gva, "gva", "n_nationkey", 8)


@query(
    "w08_first_per_group",
    """select l_suppkey, l_orderkey, l_linenumber, l_extendedprice from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc nulls last, l_orderkey, l_linenumber) as rn from lineitem) where rn=1""",
)
def w08(t):
    order = [F.col("l_extendedprice").desc_nulls_last(), F.col("l_orderkey"), F.col("l_linenumber")]
    return first_per(t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_suppkey"], order)


@query(
    "w09_consecutive_pairs",
    """with p as (select user_id, event_id, event_type, lead(event_type) over w as nxt, lag(event_type) over w as prv from events window w as (partition by user_id order by event_id))
 select user_id, event_id, event_type, nxt as next_event_type from p where prv is null or prv<>event_type""",
)
def w09(t):
    ev = t.events.select("user_id", "event_id", "event_type")
    both = next_rows(ev, ["user_id"], "event_id", "event_id", ["event_type"], ("next", "prev"))
    kept = F.col("prev_event_type").isNull() | (F.col("prev_event_type") != F.col("event_type"))
    return both.filter(kept).drop("prev_event_type")


@query(
    "w10_number_parts",
    """select l_orderkey, l_linenumber, l_partkey, l_orderkey||'#'||row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as part_id,
 row_number() over (order by l_extendedprice, l_orderkey*1000+l_linenumber) as running_id from lineitem""",
)
def w10(t):
    li = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("_tie"),
    ).withColumn("_two", F.struct("l_partkey", "l_suppkey"))
    parts = running_total(li, ["l_orderkey"], "l_linenumber", "_two", F.lit(1), "_n").drop("_two")
    out = row_numbers(parts, "l_extendedprice", "_tie", (), "running_id")
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.concat_ws("#", "l_orderkey", "_n").alias("part_id"), "running_id"
    )


@query(
    "w11_composite_score",
    """with p as (select p_partkey, p_size, p_retailprice, case when p_partkey%3>0 then ((rank() over (order by p_size)-1)+count(*) over (partition by p_size)/2.0)/count(*) over () end as a,
  1-((rank() over (order by p_retailprice)-1)+count(*) over (partition by p_retailprice)/2.0)/count(*) over () as b from part)
 select p_partkey, cast(case when a is not null then round(100*(2*a+b)/3) else round(100*b) end as int) as score from p""",
)
def w11(t):
    ranks = R.many_ranks(t.part, "p_partkey", {"size": F.col("p_size"), "price": F.col("p_retailprice")})
    size = F.when(F.col("p_partkey") % 3 > 0, R.mid_of("size"))
    return ranks.select("p_partkey", R.composite_score([size, R.mid_of("price", -1)]).alias("score"))


ANCHOR_SQL = """with s as (select p_partkey as id, p_size*100 as capacity, p_size as land, case when p_partkey%5>0 then p_retailprice end as imd, p_partkey%37 as pt,
  case when p_partkey%4>0 then p_partkey%101 end as cheap, p_partkey%13 as walk, p_partkey%17 as schools, p_partkey%19 as facilities, p_partkey%23 as beds, p_partkey%29 as venues, p_partkey%31 as food, p_partkey%41 as rail from part),
 b as (select id, percent_rank() over (order by coalesce(land,0)) l, percent_rank() over (order by coalesce(imd,50)) i, percent_rank() over (order by coalesce(pt,0)) p, percent_rank() over (order by coalesce(cheap,99999) desc) c,
  percent_rank() over (order by walk) w, percent_rank() over (order by schools) s, percent_rank() over (order by facilities) f, percent_rank() over (order by beds) bd, percent_rank() over (order by venues) v, percent_rank() over (order by food) fo, percent_rank() over (order by rail) ra
  from s where capacity>=1000),
 x as (select id, round(100*(0.4*l+0.25*i+0.2*p+0.15*c),1) as regen_index, round(100*(0.35*i+0.35*w+0.15*s+0.15*f),1) as social_index, round(100*(0.35*bd+0.25*v+0.2*fo+0.2*ra),1) as visitor_index from b)
 select *, round((regen_index+social_index+visitor_index)/3,1) as anchor_index from x"""


@query("w12_anchor_indices", ANCHOR_SQL)
def w12(t):
    k = F.col("p_partkey")
    df = t.part.select(
        k.alias("id"), (F.col("p_size") * 100).alias("capacity"), F.col("p_size").alias("land"),
        F.when(k % 5 > 0, F.col("p_retailprice")).alias("imd"), F.when(k % 4 > 0, k % 101).alias("cheap"),
        *[(k % m).alias(n) for n, m in (("pt", 37), ("walk", 13), ("schools", 17), ("facilities", 19), ("beds", 23), ("venues", 29), ("food", 31), ("rail", 41))],
    )
    return R.anchor_indices(df, "id")


@query(
    "w13_benefit_score",
    """with s as (select s_suppkey as sid, s_acctbal/100 as imd, s_suppkey%101 as amenity, case when s_suppkey%6>0 then s_suppkey%83 end as connectivity, s_suppkey%211 as y from supplier),
 r as (select *, 0.6*amenity+0.4*coalesce(connectivity,0) as access_score, 100*percent_rank() over (order by y) as housing_score from s)
 select sid, round(imd,6) as regen_score, round(access_score,6) as access_score, round(housing_score,6) as housing_score, round((0.5*imd+0.3*access_score+0.2*housing_score)/1.0,1) as benefit from r""",
)
def w13(t):
    k = F.col("s_suppkey")
    df = t.supplier.select(
        k.alias("sid"), (F.col("s_acctbal") / 100).alias("imd"), (k % 101).alias("amenity"),
        F.when(k % 6 > 0, k % 83).alias("connectivity"), (k % 211).alias("dwelling_yield"),
    )
    out = R.benefit_score(df, "sid", {"regen": 0.5, "access": 0.3, "housing": 0.2})
    return out.select("sid", *[F.round(c, 6).alias(c) for c in ("regen_score", "access_score", "housing_score")], "benefit")


@query(
    "w14_peers",
    """with v as (select p_partkey as id, p_brand as tier, ln(cast(p_size+1 as double)) as ls from part),
 r as (select a.id, b.id as peer, abs(a.ls-b.ls) as gap from v a join v b on a.id<>b.id and (a.tier=b.tier or abs(a.ls-b.ls)<0.25))
 select id, peer, round(gap,9) as gap, rn as peer_rank from (select *, row_number() over (partition by id order by gap, peer) as rn from r) where rn<=6""",
)
def w14(t):
    df = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("tier"), (F.col("p_size") + 1).alias("size"))
    return R.peers(df, "id", "tier", "size", 6).select("id", "peer", F.round("gap", 9).alias("gap"), "peer_rank")
