"""Queries for the cleaning functions; each runs over a whole table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from landgauge.catalog.registry import query
from landgauge.functions import clean as N


def pick(key: str, values: list[str | None]) -> Column:
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(arr, (F.col(key) % len(values) + 1).cast("int"))


def sql_pick(key: str, values: list[str | None]) -> str:
    quoted = ["null" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return f"([{','.join(quoted)}])[cast({key} % {len(values)} as int) + 1]"


@query(
    "n01_resolve_columns",
    "select cast(c_custkey as varchar) as area_code, c_name as area_name, c_acctbal as rent, cast(null as varchar) as region from customer",
)
def n01(t):
    messy = t.customer.select(
        F.col("c_custkey").cast("string").alias("﻿LAD23CD "),
        F.col("c_name").alias("Area\nName"),
        F.col("c_acctbal").alias("Mean rent (GBP pcm)"),
    )
    return N.resolve_columns(
        messy,
        {"area_code": [r"/lad\d*cd/"], "area_name": ["area name"], "rent": ["rent"], "region": ["region"]},
        contains=True,
        required=("area_code",),
    )


NUMBERS = ["1,234.5", "£2,000", "3.5m", "n/a", "[x]", "-", "..", " 17 ", "-4", "abc", "NaN", None]


@query(
    "n02_parse_number",
    f"""with r as (select o_orderkey, {sql_pick('o_orderkey', NUMBERS)} as raw, o_totalprice from orders),
 b as (select o_orderkey, lower(trim(raw)) as s, o_totalprice from r),
 v as (select o_orderkey, case when s not in ('','-','n/a','na','..','.','null','[x]','[z]','nan')
   then try_cast(regexp_replace(regexp_replace(s,'[,£\\s]','','g'),'m$','') as double) end as v,
   try_cast(replace('£'||printf('%.2f', o_totalprice),'£','') as double) as w from b)
 select o_orderkey, v as parsed, case when v>0 then v end as positive_only, w as price from v""",
)
def n02(t):
    raw = pick("o_orderkey", NUMBERS)
    price = F.concat(F.lit("£"), F.format_number("o_totalprice", 2))
    return t.orders.select(
        "o_orderkey",
        N.parse_number(raw).alias("parsed"),
        N.parse_number(raw, positive=True).alias("positive_only"),
        N.parse_number(price).alias("price"),
    )


@query(
    "n03_first_int",
    "select doc_id, try_cast(replace(regexp_extract(text,'\\d[\\d,]*'),',','') as bigint) as first_number from documents",
)
def n03(t):
    return t.documents.select("doc_id", N.first_int(F.col("text")).alias("first_number"))


BOOLS = ["true", "T", "1", "Yes", "y", "false", "0", "No", "maybe", None]


@query(
    "n04_parse_bool",
    f"""with r as (select c_custkey, lower(trim({sql_pick('c_custkey', BOOLS)})) as s from customer)
 select c_custkey, case when s in ('true','t','1','yes','y') then true when s in ('false','f','0','no','n') then false end as flag from r""",
)
def n04(t):
    return t.customer.select("c_custkey", N.parse_bool(pick("c_custkey", BOOLS)).alias("flag"))


@query(
    "n05_parse_dates",
    """select o_orderkey, case when o_orderkey%3=0 then null else cast(o_orderdate as date) end as iso,
 cast(o_orderdate as date) as short_date, strftime(o_orderdate,'%Y-%m') as month_key from orders""",
)
def n05(t):
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "dd/MM/yyyy")).otherwise(
        F.date_format(d, "yyyy-MM-dd")
    )
    return t.orders.select(
        "o_orderkey",
        N.parse_iso_date(text).alias("iso"),
        N.parse_yymmdd(F.date_format(d, "yyMMdd")).alias("short_date"),
        N.month_key(d).alias("month_key"),
    )


@query(
    "n06_parse_clock",
    """select event_id, (hour(ts)+5)*3600+minute(ts)*60+second(ts) as seconds,
 case when hour(ts)*60+minute(ts)=0 then null else hour(ts)*60+minute(ts) end as minutes from events""",
)
def n06(t):
    h, m, s = F.hour("ts"), F.minute("ts"), F.second("ts")
    return t.events.select(
        "event_id",
        N.clock_seconds(F.format_string("%02d:%02d:%02d", h + 5, m, s)).alias("seconds"),
        N.hhmm_minutes(F.concat(F.format_string("%02d%02d", h, m), F.when(s > 30, "H").otherwise(""))).alias(
            "minutes"
        ),
    )


PLACES = [
    "City of Westgate", "Royal Borough of Kenmore", "London Borough of Ashford & Hythe", "Dunmere District Council",
    "North and South Vale", "Ely (Cambs) Rail Station", "Bath Spa Railway Station", "Iver 400kV Substation",
    "Walpole Grid Supply Point 132 kV", "The City of Ryde UA",
]


@query(
    "n07_norm_name",
    f"""with r as (select p_partkey, lower(trim({sql_pick('p_partkey', PLACES)}||' '||p_name)) as s from part),
 g as (select *, regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(s,
  'grid supply point',' '),'supply point',' '),'substation',' '),'switching',' '),'station',' '),'s/s',' '),'gsp',' '),'bsp',' '),'grid',' '),'no.',' '),'number',' '),
  '\\b\\d+\\s*k?v\\b',' ','g') as gs from r)
 select p_partkey, regexp_replace(s,'[^a-z0-9]','','g') as alnum,
 trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s,'\\(.*?\\)',' ','g'),'\\b(rail|railway)?\\s*station\\b',' ','g'),'[^a-z0-9]+',' ','g'),'\\s+',' ','g')) as station,
 regexp_replace(s,'^(city of |royal borough of |london borough of )','') as authority,
 trim(regexp_replace(replace(regexp_replace(regexp_replace(s,'[^a-z0-9 ]',' ','g'),'\\b(city of|county of|royal borough of|london borough of|district|borough|council|ua|the|city)\\b',' ','g'),' and ',' '),'\\s+',' ','g')) as council,
 regexp_replace(gs,'[^a-z0-9]+','','g') as gridsite from g""",
)
def n07(t):
    name = F.concat_ws(" ", pick("p_partkey", PLACES), F.col("p_name"))
    return t.part.select(
        "p_partkey", *[N.norm_name(name, p).alias(p) for p in ("alnum", "station", "authority", "council", "gridsite")]
    )


@query(
    "n08_norm_postcode",
    """with r as (select c_custkey, upper('ab'||(c_custkey%90+10)||(c_custkey%9)||'xy') as p from customer)
 select c_custkey, p as bare, left(p,length(p)-3)||' '||right(p,3) as spaced from r""",
)
def n08(t):
    k = F.col("c_custkey")
    raw = F.concat(F.lit(" ab"), (k % 90 + 10).cast("string"), F.lit("  "), (k % 9).cast("string"), F.lit("xy "))
    return t.customer.select("c_custkey", N.norm_postcode(raw).alias("bare"), N.norm_postcode(raw, True).alias("spaced"))


@query(
    "n09_address_keys",
    """with r as (select s_suppkey, case when s_suppkey%2=0 then 'Flat '||(s_suppkey%7) end as saon, (s_suppkey%40)||'a' as paon, s_name as street from supplier)
 select s_suppkey, case when saon is not null then upper(regexp_replace(saon||paon||street,'[^A-Za-z0-9]','','g')) else upper(regexp_replace(paon||street,'[^A-Za-z0-9]','','g')) end as first_key,
 case when saon is not null then upper(regexp_replace(saon||paon,'[^A-Za-z0-9]','','g')) else upper(regexp_replace(paon,'[^A-Za-z0-9]','','g')) end as second_key from r""",
)
def n09(t):
    k = F.col("s_suppkey")
    saon = F.when(k % 2 == 0, F.concat(F.lit("Flat "), (k % 7).cast("string")))
    keys = N.address_keys(saon, F.concat((k % 40).cast("string"), F.lit("a")), F.col("s_name"))
    return t.supplier.select("s_suppkey", keys[0].alias("first_key"), keys[1].alias("second_key"))


@query(
    "n10_slug",
    """select p_partkey, trim(regexp_replace(lower(p_name||' / '||p_brand||'!'),'[^a-z0-9]+','_','g'),'_') as slug,
 trim(regexp_replace(lower(p_name||' / '||p_brand||'!'),'[^a-z0-9]+','-','g'),'-') as dashed from part""",
)
def n10(t):
    name = F.concat(F.col("p_name"), F.lit(" / "), F.col("p_brand"), F.lit("!"))
    return t.part.select("p_partkey", N.slug(name).alias("slug"), N.slug(name, "-").alias("dashed"))


@query(
    "n11_stable_id",
    "select c_custkey, 'gp-'||substring(md5('gp|POINT('||(c_custkey*7919)||' '||c_custkey||')'),1,16) as source_id from customer",
)
def n11(t):
    k = F.col("c_custkey")
    wkt = F.concat(F.lit("POINT("), (k * 7919).cast("string"), F.lit(" "), k.cast("string"), F.lit(")"))
    return t.customer.select("c_custkey", N.stable_id("gp", wkt).alias("source_id"))


@query(
    "n12_suffix_duplicates",
    """select l_orderkey as ref, l_linenumber as line, l_partkey as part, case when n>1 then l_suppkey||'-'||n else cast(l_suppkey as varchar) end as source_id
 from (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) as n from lineitem)""",
)
def n12(t):
    li = t.lineitem.select(
        F.col("l_suppkey").cast("string").alias("source_id"),
        F.col("l_orderkey").alias("ref"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.struct("l_linenumber", "l_partkey").alias("_tie"),
    )
    return N.suffix_duplicates(li, "source_id", "ref", "_tie").drop("_tie")


@query(
    "n13_hash_jitter",
    """with r as (select o_orderkey, md5(cast(o_orderkey as varchar)) as h from orders)
 select o_orderkey, round((cast('0x'||substring(h,1,2) as int)/255.0-0.5)*0.0004,9) as dx, round((cast('0x'||substring(h,3,2) as int)/255.0-0.5)*0.00025,9) as dy from r""",
)
def n13(t):
    dx, dy = N.hash_jitter(F.col("o_orderkey"))
    return t.orders.select("o_orderkey", F.round(dx, 9).alias("dx"), F.round(dy, 9).alias("dy"))


LEVELS = ["4;1", "3", "12; 2 ;5", None, "0", "two", "900"]
HEIGHTS = ["12.5", "40 ft", "9 m; 14 metres", None, "tall", "30'"]


@query(
    "n14_height_storeys",
    """with r as (select p_partkey, cast(p_partkey%7 as int) as a, cast(p_partkey%6 as int) as b from part),
 v as (select p_partkey, ([4.0,3.0,12.0,null,null,null,900.0])[a+1]::double as lv, ([12.5,40*0.3048,14.0,null,null,30*0.3048])[b+1]::double as h from r),
 w as (select *, coalesce(h, round(lv*3.2,1)) as hh, coalesce(lv, round(h/3.2)) as ss from v)
 select p_partkey, round(h,4) as raw_height, lv as raw_levels, case when hh>1.5 and hh<400 then round(hh,1) end as height_m,
 case when hh>1.5 and hh<400 then cast(floor(ss) as int) end as storeys from w""",
)
def n14(t):
    lv, h = N.parse_levels(pick("p_partkey", LEVELS)), N.parse_height(pick("p_partkey", HEIGHTS))
    height, storeys = N.height_storeys(h, lv)
    return t.part.select(
        "p_partkey", F.round(h, 4).alias("raw_height"), lv.alias("raw_levels"), height.alias("height_m"), storeys.alias("storeys")
    )


@query(
    "n15_parse_kv",
    """select p_partkey, case when p_partkey%4=3 then null else greatest(p_size*1000, 33000)/1000.0 end as kv from part""",
)
def n15(t):
    raw = F.when(F.col("p_partkey") % 4 == 3, "unknown").otherwise(
        F.concat((F.col("p_size") * 1000).cast("string"), F.lit(";33000;x"))
    )
    return t.part.select("p_partkey", N.parse_kv(raw).alias("kv"))


@query(
    "n16_hstore_get",
    """select p_partkey, p_brand as operator, case when p_size>25 then cast(p_size as varchar) end as height from part""",
)
def n16(t):
    raw = F.concat(
        F.lit('"operator"=>"'), F.col("p_brand"), F.lit('"'),
        F.when(F.col("p_size") > 25, F.concat(F.lit(',"height"=>"'), F.col("p_size").cast("string"), F.lit('"'))).otherwise(""),
    )
    return t.part.select("p_partkey", N.hstore_get(raw, "operator").alias("operator"), N.hstore_get(raw, "height").alias("height"))


@query(
    "n18_parse_point_text",
    """select c_custkey, round(50+c_custkey%1000/1000.0,6) as a, round(-1-c_custkey%77/100.0,6) as b from customer""",
)
def n18(t):
    k = F.col("c_custkey")
    lat, lon = F.round(50 + k % 1000 / 1000.0, 6), F.round(-1 - k % 77 / 100.0, 6)
    text = F.when(k % 2 == 0, F.concat(lat.cast("string"), F.lit(", "), lon.cast("string"))).otherwise(
        F.concat(F.lit("POINT ("), lat.cast("string"), F.lit(" "), lon.cast("string"), F.lit(")"))
    )
    a, b = N.parse_point_text(text)
    return t.customer.select("c_custkey", a.alias("a"), b.alias("b"))


@query(
    "n19_infer_scale",
    """select l_returnflag, round(sum(case when m<=2 then l_discount*100 else l_discount end),4) as pct_sum
 from lineitem, (select quantile_cont(l_discount,0.5) as m from lineitem) group by 1""",
)
def n19(t):
    li = N.infer_scale(t.lineitem.select("l_returnflag", "l_discount"), "l_discount", [(2, 100)], (0, 100))
    return li.groupBy("l_returnflag").agg(F.round(F.sum("l_discount"), 4).alias("pct_sum"))


@query(
    "n20_json_number",
    "select event_id, try_cast(json_extract_string(props,'$.k') as double) as k, cast(null as double) as missing from events",
)
def n20(t):
    return t.events.select(
        "event_id", N.json_number(F.col("props"), "k").alias("k"), N.json_number(F.col("props"), "nope").alias("missing")
    )


@query(
    "n21_props_algebra",
    """select event_id, case when event_id%2=0 then 'over' else cast(json_extract_string(props,'$.k') as varchar) end as k,
 event_type as kind, true as has_k, case when event_id%2=0 then 2 else 2 end as n_kept,
 case when event_id%3=0 then 1 else 2 end as n_clean from events""",
)
def n21(t):
    base = F.from_json("props", "map<string,string>")
    extra = F.create_map(
        F.lit("kind"), F.col("event_type"),
        F.lit("note"), F.when(F.col("event_id") % 3 != 0, F.lit("x")),
    )
    over = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.lit("over"))).otherwise(
        F.create_map().cast("map<string,string>")
    )
    merged = N.props_merge(N.props_merge(base, extra), over)
    return t.events.select(
        "event_id",
        merged["k"].alias("k"),
        merged["kind"].alias("kind"),
        F.map_contains_key(merged, "k").alias("has_k"),
        F.size(N.props_project(merged, "k", "kind")).alias("n_kept"),
        F.size(N.props_strip_nulls(N.props_drop(merged, "k"))).alias("n_clean"),
    )


@query(
    "n22_tidy_text",
    "select doc_id, nullif(substring(trim(regexp_replace(text,'\\s+',' ','g')),1,40),'') as tidy, length(trim(regexp_replace(text,'\\s+',' ','g'))) as n from documents",
)
def n22(t):
    c = F.col("text")
    return t.documents.select("doc_id", N.tidy_text(c, 40).alias("tidy"), F.length(N.tidy_text(c)).alias("n"))


@query(
    "n23_period_score",
    """with r as (select o_orderkey, year(o_orderdate)+10 as y, quarter(o_orderdate) as q, month(o_orderdate) as m, cast(o_orderkey%7 as int) as k from orders)
 select o_orderkey, round(case k when 0 then y+q*0.25-0.1 when 1 then y+0.45 when 2 then y+0.9 when 3 then y+m/12.0 when 4 then 0 when 5 then y else y+q*0.25-0.1 end,6) as score from r""",
)
def n23(t):
    y = (F.year("o_orderdate") + 10).cast("string")
    text = F.element_at(
        F.array(
            F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit(" "), y),
            F.concat(F.lit("H1 "), y),
            F.concat(F.lit("Year-end "), y),
            F.concat(F.date_format("o_orderdate", "MMM"), F.lit(" "), y),
            F.concat(F.lit("Forecast "), y),
            y,
            F.concat(F.lit("H2, Q"), F.quarter("o_orderdate").cast("string"), F.lit(" "), y, F.lit(" / Q1 2029 to end of May")),
        ),
        (F.col("o_orderkey") % 7 + 1).cast("int"),
    )
    # decades before 2000 carry no 20xx year; the derived years are all 2000s
    return t.orders.select("o_orderkey", F.round(N.period_score(text), 6).alias("score"))


@query(
    "n24_in_bounds",
    """select c_custkey, (-10+c_custkey%15) between -8.7 and 1.9 and (45+c_custkey%20) between 49.8 and 60.9 as inside from customer""",
)
def n24(t):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", N.in_bounds(-10 + k % 15, 45 + k % 20, N.GB_BOX).alias("inside"))
