"""Queries for readers, loading rules and exports; files are written by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from landgauge.catalog import bindings as B
from landgauge.catalog.registry import query
from landgauge.functions import geometry as G
from landgauge.session import scratch_path
from landgauge.sources import features as FT
from landgauge.sources import tables as TB
from landgauge.sources import text as TX
from landgauge.streaming.landing import latest_version, stream_upsert


@query("s01_read_delimited", "select c_mktsegment as segment, count(*) as n, round(sum(c_acctbal),2) as balance from customer group by 1")
def s01(t):
    """Every part file gets a preamble and a wrapped header; some rows are not UTF-8."""
    path = scratch_path(t.spark, "delimited")
    row = F.concat_ws("\t", F.col("c_custkey").cast("string"), F.concat(F.lit('"'), "c_mktsegment", F.lit('"')), F.col("c_acctbal").cast("string"))
    body = t.customer.select(F.spark_partition_id().alias("p"), F.lit(2).alias("o"), F.col("c_custkey").alias("k"), row.alias("line"))
    heads = body.select("p").distinct().withColumn("h", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit("Published table, figures in pounds").alias("line")), F.struct(F.lit(1).alias("o"), F.lit("Area Code\tMarket  Segment\tAccount balance (GBP)").alias("line")))))
    both = body.unionByName(heads.select("p", F.col("h.o"), F.lit(-1).cast("bigint").alias("k"), "h.line"))
    both.repartition("p").sortWithinPartitions("p", "o", "k").select("line").write.text(path)
    got = TX.read_delimited(t.spark, path, {"code": ["area code"], "segment": ["market segment"], "balance": ["account balance"]})
    return got.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("balance").cast("double")), 2).alias("balance"))


@query("s02_read_geojson", B.ctes(B.SITES_SQL) + "select p_type as kind, count(*) as n, sum((maxx-minx)*(maxy-miny)) as m2 from sites where site_id%5>0 group by 1")
def s02(t):
    path = scratch_path(t.spark, "geojson")
    ring = lambda xs: F.array(*[F.array(F.col(a), F.col(b)) for a, b in xs])
    square = ring([("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny")])
    doc = F.to_json(F.struct(F.lit("Feature").alias("type"), F.create_map(F.lit("kind"), F.col("p_type")).alias("properties"),
                             F.struct(F.lit("Polygon").alias("type"), F.array(square).alias("coordinates")).alias("geometry")))
    line = F.when(F.col("site_id") % 5 == 0, F.lit('{"type": "Feature", broken')).otherwise(F.concat(F.lit("\x1e"), doc))
    B.sites(t).select(line).write.text(path)
    got = TX.read_geojson(t.spark, path)
    return got.groupBy(F.col("props")["kind"].alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(G.ring_area(F.col("rings"))).alias("m2"))


@query("s03_read_fixed_width", "select lpad(cast(l_orderkey as varchar),6,'0') as uid, count(*) as n_calls, min(l_linenumber) as first_minute, max(l_linenumber) as last_minute from lineitem group by 1")
def s03(t):
    """Orders as schedules (BS) followed by their lines as LI calls, in one fixed-width file."""
    path = scratch_path(t.spark, "fixed")
    key = F.lpad(F.col("l_orderkey").cast("string"), 6, "0")
    calls = t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("s"), F.concat(F.lit("LI"), F.lpad(F.col("l_partkey").cast("string"), 7, "0"), F.lit(" "), F.format_string("%04d ", F.col("l_linenumber"))).alias("line"))
    heads = t.lineitem.select("l_orderkey").distinct().select(F.col("l_orderkey").alias("o"), F.lit(0).alias("s"), F.concat(F.lit("BSN"), F.lpad(F.col("l_orderkey").cast("string"), 6, "0"), F.lit("980101981231"), F.lit("1111100"), F.lit(" P")).alias("line"))
    calls.unionByName(heads).repartitionByRange("o").sortWithinPartitions("o", "s").select("line").write.text(path)
    _ = key
    rows = TX.read_fixed_width(t.spark, path)
    return rows.groupBy("file", "schedule").agg(F.max("uid").alias("uid"), F.count_if(F.col("rec") == "LI").alias("n_calls"), F.min(F.col("arrive").try_cast("int")).alias("first_minute"), F.max(F.col("arrive").try_cast("int")).alias("last_minute")).drop("file", "schedule")


@query("s04_read_coded_records", "select p_partkey as uarn, p_type as kind, p_retailprice as value from part where p_partkey%4>0")
def s04(t):
    line = F.concat_ws("*", F.when(F.col("p_partkey") % 4 > 0, "01").otherwise("02"), F.col("p_partkey").cast("string"), F.lit(""), F.col("p_type"), F.col("p_retailprice").cast("string"))
    got = TX.read_coded_records(t.part.select(line.alias("line")), "line", "01", "*", {"uarn": 1, "kind": 3, "value": 4})
    return got.select(F.col("uarn").cast("bigint").alias("uarn"), "kind", F.col("value").cast("double").alias("value"))


@query("s05_read_gtfs", "select event_type as stop_id, count(*) as n, count(distinct user_id) as n_trips from events group by 1")
def s05(t):
    path = scratch_path(t.spark, "gtfs")
    clock = F.date_format("ts", "HH:mm:ss")
    t.events.select(F.col("user_id").cast("string").alias("trip_id"), clock.alias("arrival_time"), clock.alias("departure_time"), F.col("event_type").alias("stop_id"), F.col("event_id").cast("int").alias("stop_sequence")).write.csv(f"{path}/stop_times", header=True)
    feed = TX.read_gtfs(t.spark, path, ["stop_times"], suffix="")
    return feed["stop_times"].groupBy("stop_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("trip_id").alias("n_trips"))


@query("s06_read_ascii_grid", "select cast(o_orderkey//100 as bigint) as tile, count(*) as n, round(sum(o_totalprice),2) as z from orders where o_orderkey%100<>7 group by 1")
def s06(t):
    """Orders as 10 x 10 elevation tiles (one text file each; a no-data cell in each, and where there is no order)."""
    path = scratch_path(t.spark, "ascii")
    k = F.col("o_orderkey")
    z = F.when(k % 100 == 7, "-9999").otherwise(F.col("o_totalprice").cast("string"))
    known = t.orders.groupBy(k.alias("cell")).agg(F.max(z).alias("z"))
    # cells that no order has are padded with the no-data value
    board = t.orders.select(F.floor(k / 100).alias("tile")).distinct().withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.col("tile") * 100 + i)))
    cells = board.join(known, "cell", "left").select("tile", "cell", F.floor(F.col("cell") % 100 / 10).alias("row"), F.coalesce("z", F.lit("-9999")).alias("z"))
    rows = cells.groupBy("tile", "row").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("cell", "z"))), lambda s: s.z)).alias("line"))
    tiles = rows.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("row", "line"))).alias("body"))
    head = F.concat(F.lit("ncols 10\nnrows 10\nxllcorner "), (F.col("tile") * 1000).cast("string"), F.lit("\nyllcorner 0\ncellsize 100\nNODATA_value -9999\n"))
    doc = F.concat(head, F.array_join(F.transform("body", lambda s: s.line), "\n"), F.lit("\n"))
    # one tile per file
    tiles.select(doc.alias("value"), F.col("tile").alias("t")).write.partitionBy("t").text(path)
    got = TX.read_ascii_grid(t.spark, f"{path}/t=*/*.txt")
    return got.groupBy(F.floor(F.col("x") / 1000).alias("tile")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("z"), 2).alias("z"))


@query("s07_explode_document", "select o_custkey as doc, o_orderkey as uid, o_orderstatus as state from orders where o_orderstatus<>'P'")
def s07(t):
    item = F.struct(F.col("o_orderkey").alias("uid"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("state"))
    docs = t.orders.groupBy(F.col("o_custkey").alias("doc")).agg(F.to_json(F.struct(F.collect_list(item).alias("elements"))).alias("body"))
    return TX.explode_document(docs, "body", "elements", "uid:bigint,state:string", ["state"], ["doc"])


@query("s08_stitch_pages", "select l_orderkey as oid, min_by(l_partkey, l_linenumber*1000000+l_partkey) as part from lineitem group by 1")
def s08(t):
    pages = t.lineitem.select(F.col("l_orderkey").alias("oid"), F.col("l_partkey").alias("part"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("page"), F.lit(False).alias("more"))
    return TX.stitch_pages(pages, "oid", "page", "more").select("oid", "part")


@query(
    "s09_unpivot_series",
    "select c_custkey as code, s.series, case when s.series='rent' and c_custkey%4=0 then null when s.series='rent' then c_acctbal else c_custkey%7 end as value from customer, (values ('rent'),('change')) s(series) where c_custkey%10<>3",
)
def s09(t):
    k = F.col("c_custkey")
    wide = t.customer.select(k.alias("code"), F.when(k % 10 == 3, "K02").otherwise("E06").alias("area"), F.when(k % 4 == 0, "[x]").otherwise(F.col("c_acctbal").cast("string")).alias("c7"), (k % 7).cast("string").alias("c9"))
    return TX.unpivot_series(wide, ["code", "area"], {"rent": "c7", "change": "c9"}, "area", "^[EW]").drop("area")


@query(
    "s10_emit_features",
    "select 'gp' as dataset, case when c_custkey%3=0 then 'gp-'||substring(md5('gp|POINT('||c_custkey||' 0)'),1,16) else 'c'||c_custkey end as source_id, c_name as name, json_extract_string('{\"seg\":\"'||c_mktsegment||'\"}','$.seg') as seg, case when c_custkey%2=0 then 2 else 1 end as n_props from customer where c_custkey%7>0",
)
def s10(t):
    k = F.col("c_custkey")
    geom = F.when(k % 7 > 0, F.concat(F.lit("POINT("), k.cast("string"), F.lit(" 0)")))
    out = FT.emit_features(t.customer, "gp", F.col("c_name"), {"seg": F.col("c_mktsegment"), "note": F.when(k % 2 == 0, "x")}, geom, F.when(k % 3 > 0, F.concat(F.lit("c"), k.cast("string"))))
    props = F.from_json("props", "map<string,string>")
    return out.select("dataset", "source_id", "name", props["seg"].alias("seg"), F.size(props).alias("n_props"))


@query("s11_replace_dataset", "select c_mktsegment as dataset, count(*) as n, case when c_mktsegment='BUILDING' then 2 else 1 end as version from customer where c_mktsegment<>'BUILDING' or c_custkey%2=0 group by 1")
def s11(t):
    path = scratch_path(t.spark, "features")
    base = t.customer.select(F.col("c_mktsegment").alias("dataset"), "c_custkey", F.lit(1).alias("version"))
    TB.replace_dataset(base, path)
    TB.replace_dataset(base.filter("dataset = 'BUILDING' and c_custkey % 2 = 0").withColumn("version", F.lit(2)), path)
    return t.spark.read.parquet(path).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.max("version").alias("version"))


@query(
    "s12_upsert",
    "select c_custkey as k, case when o.v is null then c_acctbal else o.v end as v from customer full join (select o_custkey, max_by(o_totalprice, (o_orderdate, o_orderkey)) as v from orders where o_orderkey%2=0 group by 1) o on o_custkey=c_custkey",
)
def s12(t):
    base = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.struct(F.lit("1900-01-01").cast("timestamp").alias("d"), F.lit(0).cast("bigint").alias("i")).alias("at"))
    delta = t.orders.filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.struct(F.col("o_orderdate").alias("d"), F.col("o_orderkey").alias("i")).alias("at"))
    return TB.upsert(base, delta, ["k"], "at").select("k", "v")


@query(
    "s13_insert_ignore",
    "select c_custkey as k, c_acctbal as v from customer where c_custkey%2=0 union all select o_custkey, min_by(o_totalprice, o_orderkey) from orders where o_custkey%2=1 group by 1",
)
def s13(t):
    base = t.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    delta = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderkey")
    return TB.insert_ignore(base.withColumn("o_orderkey", F.lit(0).cast("bigint")), delta, ["k"], [F.col("o_orderkey")]).select("k", "v")


@query("s14_patch_column", "select c_custkey as k, case when c_custkey%3=0 then c_acctbal+1 else c_acctbal end as v from customer")
def s14(t):
    base = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    delta = t.customer.select((F.col("c_custkey") * 3).alias("k")).join(base, "k", "left").select("k", (F.coalesce("v", F.lit(0.0)) + 1).alias("v"))
    return TB.patch_column(base, delta, ["k"], "v").select("k", "v")


@query("s15_append_dataset", "select c_custkey as k, c_acctbal as v from customer where c_custkey%3<2 union all select c_custkey+1000000, c_acctbal from customer where c_custkey%3=2")
def s15(t):
    c = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(1).alias("at"))
    base = c.filter("k % 3 < 2").withColumn("v", F.when(F.col("k") % 3 == 0, -1.0).otherwise(F.col("v")))
    delta = c.filter("k % 3 = 0").unionByName(c.filter("k % 3 = 2").withColumn("k", F.col("k") + 1000000))
    return TB.append_dataset(base, delta, ["k"], "at").select("k", "v")


@query("s16_stamp_dataset", f"select c_mktsegment as dataset, count(*) as n_rows, date '{B.AS_OF}' as loaded_at from customer group by 1")
def s16(t):
    return TB.stamp_dataset(t.customer.select(F.col("c_mktsegment").alias("dataset")), F.lit(B.AS_OF).cast("date"))


@query("s17_keyset_page", "select c_custkey, c_name from customer where c_custkey>77 order by c_custkey limit 200")
def s17(t):
    return TB.keyset_page(t.customer, "c_custkey", 77, 200, ["c_name"])


@query("s18_feature_collection", B.ctes(B.AMENITIES_SQL) + "select least(count(*),500) as n, 0 as first_id, cast(least(count(*),500) as bigint)-1 as last_id from amenities")
def s18(t):
    am = B.amenities(t).select(F.col("id").alias("source_id"), F.create_map(F.lit("kind"), F.col("kind")).alias("props"), F.to_json(F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))).alias("geom_json"))
    doc = TB.to_feature_collection(am, "source_id", 500)
    return doc.select("n", F.get_json_object("doc", "$.features[0].id").cast("int").alias("first_id"), F.element_at(F.from_json(F.get_json_object("doc", "$.features[*].id"), "array<bigint>"), -1).alias("last_id"))


@query("s19_export_ranked", "select o_orderkey as id, o_totalprice as score from orders where o_totalprice>250000")
def s19(t):
    path = scratch_path(t.spark, "ranked")
    kept = t.orders.filter("o_totalprice > 250000").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    TB.export_ranked(kept, [F.col("score").desc(), F.col("id")], ["id", "score"], path, ["gate: score > 250000"])
    return t.spark.read.csv(f"{path}/rows", header=True, schema="id bigint, score double")


@query("s20_stream_upsert", "select user_id as k, arg_max(value, event_id) as v, max(event_id) as at from events group by 1")
def s20(t):
    """Events land as a file stream; each micro-batch upserts the latest value per user."""
    path = scratch_path(t.spark, "stream")
    t.events.select(F.col("user_id").alias("k"), F.col("value").alias("v"), F.col("event_id").alias("at"), "ts").repartition(3).write.parquet(f"{path}/in")
    stream = t.spark.readStream.schema("k bigint, v double, at bigint, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    stream_upsert(stream.drop("ts"), f"{path}/out", ["k"], "at", f"{path}/ck").awaitTermination()
    return latest_version(t.spark, f"{path}/out").select("k", "v", "at")


