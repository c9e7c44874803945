"""Domain roles played by the driver's tables, in Spark and in DuckDB SQL.

The tables hold no geography, so points and rectangles are derived from keys
with the same integer arithmetic on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgauge.catalog.registry import Tables

AS_OF = "2001-01-01"
EXTENT = 100_000  # metres, square


def px(key: Column) -> Column:
    return ((key * 7919) % EXTENT).cast("double")


def py(key: Column) -> Column:
    return ((key * 104729) % EXTENT).cast("double")


def sql_xy(key: str) -> str:
    return f"cast(({key}*7919)%{EXTENT} as double) as x, cast(({key}*104729)%{EXTENT} as double) as y"


PTYPE_SQL = """case when l_returnflag='A' and l_linestatus='F' then 'D'
  when l_returnflag='A' then 'S' when l_returnflag='N' and l_linestatus='F' then 'T'
  when l_returnflag='N' then 'F' else 'O' end"""


def sales(t: Tables) -> DataFrame:
    """lineitem as dwelling sales: price, floor area, type, date and a point."""
    li = t.lineitem
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return li.select(
        F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber")).alias("sale_id"),
        F.round("l_extendedprice").cast("bigint").alias("price"),
        F.when(F.col("l_quantity") >= 15, F.col("l_quantity")).alias("m2"),
        F.when((flag == "A") & (status == "F"), "D")
        .when(flag == "A", "S")
        .when((flag == "N") & (status == "F"), "T")
        .when(flag == "N", "F")
        .otherwise("O")
        .alias("ptype"),
        F.to_date("l_shipdate").alias("sold"),
        px(F.col("l_partkey")).alias("x"),
        py(F.col("l_partkey")).alias("y"),
        F.col("l_suppkey").alias("area_key"),
    ).withColumn("ppm2r", F.col("price") / F.col("m2"))


SALES_SQL = f"""sales as (select *, price/m2 as ppm2r from (
 select l_orderkey||'-'||l_linenumber as sale_id, cast(round(l_extendedprice) as bigint) as price,
 case when l_quantity>=15 then l_quantity end as m2, {PTYPE_SQL} as ptype,
 cast(l_shipdate as date) as sold, {sql_xy('l_partkey')}, l_suppkey as area_key from lineitem))"""


def points(df: DataFrame, key: str, *cols: str) -> DataFrame:
    return df.select(
        F.col(key).alias("id"), px(F.col(key)).alias("x"), py(F.col(key)).alias("y"), *cols
    )


def amenities(t: Tables) -> DataFrame:
    """customer as amenity points; the market segment is the kind."""
    seg = F.col("c_mktsegment")
    kind = (
        F.when(seg == "AUTOMOBILE", "gp")
        .when(seg == "BUILDING", "pharmacy")
        .when(seg == "FURNITURE", "school")
        .when(seg == "HOUSEHOLD", "nursery")
        .otherwise("bus")
    )
    return points(t.customer.withColumn("kind", kind), "c_custkey", "kind", "c_acctbal", "c_nationkey")


AMENITIES_SQL = f"""amenities as (select c_custkey as id, {sql_xy('c_custkey')},
 case c_mktsegment when 'AUTOMOBILE' then 'gp' when 'BUILDING' then 'pharmacy'
  when 'FURNITURE' then 'school' when 'HOUSEHOLD' then 'nursery' else 'bus' end as kind,
 c_acctbal, c_nationkey from customer)"""


def stations(t: Tables) -> DataFrame:
    """supplier as stations, offset so that they do not sit on amenities."""
    k = F.col("s_suppkey")
    return t.supplier.select(
        k.alias("sid"),
        ((k * 3571 + 37) % EXTENT).cast("double").alias("sx"),
        ((k * 86028 + 51) % EXTENT).cast("double").alias("sy"),
        "s_nationkey",
        "s_acctbal",
    )


STATIONS_SQL = f"""stations as (select s_suppkey as sid,
 cast((s_suppkey*3571+37)%{EXTENT} as double) as sx, cast((s_suppkey*86028+51)%{EXTENT} as double) as sy,
 s_nationkey, s_acctbal from supplier)"""


def venues(t: Tables) -> DataFrame:
    """part as venues or hotels."""
    return points(
        t.part.withColumn("cap", F.col("p_size") * 200), "p_partkey", "cap", "p_type", "p_brand", "p_size"
    )


VENUES_SQL = f"""venues as (select p_partkey as id, {sql_xy('p_partkey')}, p_size*200 as cap,
 p_type, p_brand, p_size from part)"""


def areas(t: Tables) -> DataFrame:
    """nation as a 5 x 5 board of 20 km squares."""
    k = F.col("n_nationkey")
    x0 = ((k % 5) * 20000).cast("double")
    y0 = (F.floor(k / 5) * 20000).cast("double")
    return t.nation.select(
        k.alias("area_id"),
        F.col("n_name").alias("area_name"),
        F.col("n_regionkey").alias("region_id"),
        x0.alias("minx"),
        y0.alias("miny"),
        (x0 + 20000).alias("maxx"),
        (y0 + 20000).alias("maxy"),
    )


AREAS_SQL = """areas as (select n_nationkey as area_id, n_name as area_name, n_regionkey as region_id,
 cast((n_nationkey%5)*20000 as double) as minx, cast((n_nationkey//5)*20000 as double) as miny,
 cast((n_nationkey%5)*20000+20000 as double) as maxx, cast((n_nationkey//5)*20000+20000 as double) as maxy
 from nation)"""

KINDS = ("built_land", "green_space", "sssi", "conservation_area", "green_belt")


def blocks(t: Tables) -> DataFrame:
    """supplier and part as grid-aligned rectangles (100 m steps), five kinds."""
    k = F.col("s_suppkey")
    x0 = (((k * 7919) % 1000) * 100).cast("double")
    y0 = (((k * 104729) % 1000) * 100).cast("double")
    w = (200 + 100 * (k % 9)).cast("double")
    h = (300 + 100 * (k % 7)).cast("double")
    kind = F.element_at(F.array(*[F.lit(x) for x in KINDS]), (k % 5 + 1).cast("int"))
    return t.supplier.select(
        k.alias("block_id"), kind.alias("kind"), x0.alias("minx"), y0.alias("miny"),
        (x0 + w).alias("maxx"), (y0 + h).alias("maxy"), F.col("s_acctbal").alias("worth"),
        F.col("s_nationkey").alias("owner"),
    )


BLOCKS_SQL = """blocks as (select s_suppkey as block_id,
 case s_suppkey%5 when 0 then 'built_land' when 1 then 'green_space' when 2 then 'sssi'
  when 3 then 'conservation_area' else 'green_belt' end as kind,
 cast(((s_suppkey*7919)%1000)*100 as double) as minx, cast(((s_suppkey*104729)%1000)*100 as double) as miny,
 cast(((s_suppkey*7919)%1000)*100+200+100*(s_suppkey%9) as double) as maxx,
 cast(((s_suppkey*104729)%1000)*100+300+100*(s_suppkey%7) as double) as maxy,
 s_acctbal as worth, s_nationkey as owner from supplier)"""


def sites(t: Tables) -> DataFrame:
    """part as candidate sites: grid-aligned rectangles of 300 to 1200 m."""
    k = F.col("p_partkey")
    x0 = (((k * 613) % 1000) * 100).cast("double")
    y0 = (((k * 7127) % 1000) * 100).cast("double")
    side = (300 + 100 * (k % 10)).cast("double")
    return t.part.select(
        k.alias("site_id"), x0.alias("minx"), y0.alias("miny"), (x0 + side).alias("maxx"),
        (y0 + side).alias("maxy"), "p_type", "p_brand", "p_size", "p_retailprice",
    )


SITES_SQL = """sites as (select p_partkey as site_id,
 cast(((p_partkey*613)%1000)*100 as double) as minx, cast(((p_partkey*7127)%1000)*100 as double) as miny,
 cast(((p_partkey*613)%1000)*100+300+100*(p_partkey%10) as double) as maxx,
 cast(((p_partkey*7127)%1000)*100+300+100*(p_partkey%10) as double) as maxy,
 p_type, p_brand, p_size, p_retailprice from part)"""


def calls(t: Tables) -> DataFrame:
    """events as timetable calls: trip = user, stop = event type, clock minute of the day."""
    return t.events.select(
        F.col("user_id").alias("trip"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("stop"),
        "ts",
        (F.hour("ts") * 60 + F.minute("ts")).alias("minute"),
        F.hour("ts").alias("hour"),
        F.col("value"),
        "props",
    )


CALLS_SQL = """calls as (select user_id as trip, event_id as seq, event_type as stop, ts,
 hour(ts)*60+minute(ts) as minute, hour(ts) as hour, value, props from events)"""


def ctes(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"
