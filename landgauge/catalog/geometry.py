"""Queries for geometry scalars and the cell algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from landgauge.catalog import bindings as B
from landgauge.catalog.registry import query
from landgauge.functions import geometry as G
from landgauge.operators import cells as K
from landgauge.operators import overlay as O
from landgauge.operators import regions as R
from landgauge.session import cut_lineage, spread

CELL = 100.0


def rings(df, key):
    return df.withColumn("rings", G.rect_rings(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy")))


def block_cover(t):
    return K.cover(rings(B.blocks(t), "block_id"), ["block_id", "kind"], CELL)


def site_cover(t):
    return K.cover(rings(B.sites(t), "site_id"), ["site_id"], CELL)


def moved(df):
    """The rectangles 37 m east and 41 m north of where they are, so they lie across the grid."""
    return df.withColumns({"minx": F.col("minx") + 37, "maxx": F.col("maxx") + 37, "miny": F.col("miny") + 41, "maxy": F.col("maxy") + 41})


MOVED_SQL = """moved as (select * replace (minx+37 as minx, maxx+37 as maxx, miny+41 as miny, maxy+41 as maxy) from sites)"""


def block_shapes(t):
    return rings(B.blocks(t), "block_id").select("block_id", "kind", "rings")


def block_pieces(t, *keys):
    return O.fragments(block_shapes(t), list(keys), 250.0)


def site_pieces(t):
    """Sites across the grid."""
    return O.fragments(rings(moved(B.sites(t)), "site_id").select("site_id", "rings"), ["site_id"], 250.0)


# cells of grid-aligned rectangles, in SQL
BLOCK_CELLS_SQL = """block_cells as (select block_id, kind, gx.cx, gy.cy from blocks,
 (select unnest(range(0,1100)) as cx) gx, (select unnest(range(0,1100)) as cy) gy
 where gx.cx*100>=minx and gx.cx*100<maxx and gy.cy*100>=miny and gy.cy*100<maxy)"""
SITE_CELLS_SQL = """site_cells as (select site_id, gx.cx, gy.cy from sites,
 (select unnest(range(0,1100)) as cx) gx, (select unnest(range(0,1100)) as cy) gy
 where gx.cx*100>=minx and gx.cx*100<maxx and gy.cy*100>=miny and gy.cy*100<maxy)"""


@query(
    "g01_projection",
    """select c_custkey, round(-6+(c_custkey%700)/100.0,5) as lng, round(50+(c_custkey%900)/100.0,5) as lat, round((-6+(c_custkey%700)/100.0)*111320*cos(radians(51.5)),3) as kx, round((50+(c_custkey%900)/100.0)*110540,3) as ky, true as on_grid from customer""",
)
def g01(t):
    """Projects to grid metres and back; the round trip returns the input to 1e-5 degrees."""
    k = F.col("c_custkey")
    lng, lat = -6 + (k % 700) / 100.0, 50 + (k % 900) / 100.0
    df = t.customer.select("c_custkey", lng.alias("lng0"), lat.alias("lat0"))
    df = G.to_lonlat(G.to_metres(df, "lng0", "lat0"), "e", "n", "lng", "lat")
    kx, ky = G.local_metres(F.col("lng0"), F.col("lat0"), F.lit(51.5))
    return df.select(
        "c_custkey", F.round("lng", 5).alias("lng"), F.round("lat", 5).alias("lat"), F.round(kx, 3).alias("kx"), F.round(ky, 3).alias("ky"),
        (F.col("e").between(0, 700000) & F.col("n").between(0, 1300000)).alias("on_grid"),
    )


@query(
    "g02_haversine",
    """select c_custkey, round(2*6371000*asin(sqrt(pow(sin(radians(0.01*(c_custkey%50))/2),2)+cos(radians(51.0))*cos(radians(51.0+0.01*(c_custkey%50)))*pow(sin(radians(0.02*(c_custkey%70))/2),2))),3) as metres from customer""",
)
def g02(t):
    k = F.col("c_custkey")
    d = G.haversine_m(F.lit(0.0), F.lit(51.0), 0.02 * (k % 70), 51.0 + 0.01 * (k % 50))
    return t.customer.select("c_custkey", F.round(d, 3).alias("metres"))


@query(
    "g03_ring_area",
    B.ctes(B.SITES_SQL) + "select site_id, (maxx-minx)*(maxy-miny)-10000 as area_m2, round(((maxx-minx)*(maxy-miny)-10000)/10000.0,4) as ha from sites",
)
def g03(t):
    df = rings(B.sites(t), "site_id")
    hole = G.rect_rings(F.col("minx") + 100, F.col("miny") + 100, F.col("minx") + 200, F.col("miny") + 200)
    holed = F.concat(F.col("rings"), hole)
    return df.select("site_id", G.ring_area(holed).alias("area_m2"), F.round(G.area_ha(holed), 4).alias("ha"))


@query(
    "g04_envelope",
    B.ctes(B.SITES_SQL) + "select site_id, minx-50 as minx, miny-50 as miny, maxx+50 as maxx, maxy+50 as maxy from sites",
)
def g04(t):
    df = rings(B.sites(t), "site_id").select("site_id", G.expand(G.envelope(F.col("rings")), 50.0).alias("b"))
    return df.select("site_id", "b.*")


@query(
    "g05_cover",
    B.ctes(B.SITES_SQL, SITE_CELLS_SQL) + "select site_id, count(*) as n_cells, count(*)*1e4 as area_m2, count(*) as n_full from site_cells group by 1",
)
def g05(t):
    return site_cover(t).groupBy("site_id").agg(
        F.count(F.lit(1)).alias("n_cells"), F.round(F.sum("area"), 3).alias("area_m2"), F.count_if("full").alias("n_full")
    )


@query(
    "g05_cover_triangles",
    B.ctes(B.SITES_SQL) + "select site_id, (maxx-minx)*(maxy-miny)/2 as area_m2 from sites",
)
def g05_triangles(t):
    """Right triangles: partial cells add up to the exact area."""
    pt = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    tri = F.array(F.array(pt("minx", "miny"), pt("maxx", "miny"), pt("minx", "maxy"), pt("minx", "miny")))
    cov = K.cover(B.sites(t).withColumn("rings", tri), ["site_id"], 130.0)
    return cov.groupBy("site_id").agg(F.round(F.sum("area"), 3).alias("area_m2"))


@query(
    "g06_disc_cells",
    B.ctes(B.STATIONS_SQL)
    + """, s as (select sid, sx, sy, 300+(sid%4)*100.0 as r, gx.o+cast(floor(sx/100) as int) as cx, gy.o+cast(floor(sy/100) as int) as cy from stations, (select unnest(range(-8,9)) as o) gx, (select unnest(range(-8,9)) as o) gy)
 select sid, count(*) as n_cells, sum(cx) as sum_cx, sum(cy) as sum_cy from s where sqrt(pow((cx+0.5)*100-sx,2)+pow((cy+0.5)*100-sy,2))<=r group by 1""".replace(", s as", ", s as", 1),
)
def g06(t):
    s = B.stations(t)
    cells = K.disc_cells(s, ["sid"], F.col("sx"), F.col("sy"), 300 + (F.col("sid") % 4) * 100.0, CELL)
    return cells.groupBy("sid").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("cx").alias("sum_cx"), F.sum("cy").alias("sum_cy"))


@query(
    "g07_dilate_and_clip",
    B.ctes(B.STATIONS_SQL, B.BLOCKS_SQL, BLOCK_CELLS_SQL)
    + """, grown as (select distinct cx+i.o as cx, cy+j.o as cy from block_cells, (select unnest([-1,0,1]) as o) i, (select unnest([-1,0,1]) as o) j where kind='built_land' and abs(i.o)+abs(j.o)<=1),
 disc as (select sid, gx.o+cast(floor(sx/100) as int) as cx, gy.o+cast(floor(sy/100) as int) as cy, sx, sy from stations, (select unnest(range(-22,23)) as o) gx, (select unnest(range(-22,23)) as o) gy)
 select sid, count(*) as n_cells from disc join grown using (cx, cy) where sqrt(pow((cx+0.5)*100-sx,2)+pow((cy+0.5)*100-sy,2))<=2000 group by 1""",
)
def g07(t):
    """Discs are runs of cells per grid column and stay so: what is clipped to is their union, what is counted are shared ranges."""
    disc = O.disc_runs(spread(B.stations(t)), ["sid"], F.col("sx"), F.col("sy"), 2000, CELL)
    ground = cut_lineage(R.cells_of(R.merge(disc, []), []))
    built = K.cover(rings(B.blocks(t).filter("kind = 'built_land'"), "block_id"), ["block_id"], CELL).select("cx", "cy").distinct()
    grown = R.runs_of(K.dilate(built, [], 1, within=ground), [])
    met = O.within(disc, cut_lineage(grown), [], [])
    return R.size_of(met, ["sid"])


@query(
    "g07_standoff",
    B.ctes(B.SITES_SQL, MOVED_SQL)
    + "select site_id, w, round((maxx-minx+2*w)*(maxy-miny+2*w)-(4*w*w-16*w*w*sin(pi()/16)),4) as area_m2 from (select *, 4e0+site_id%12 as w from moved)",
)
def g07_standoff(t):
    """Stand-offs of 4 to 15 m by class round rectangles, far below the cell size; corners are 32-gons."""
    s = rings(moved(B.sites(t)), "site_id").withColumn("w", F.lit(4.0) + F.col("site_id") % 12).select("site_id", "w", "rings")
    grown = s.unionByName(O.standoff(s, ["site_id", "w"], F.col("w")))
    area = O.total(O.union(O.fragments(grown, ["site_id", "w"], CELL), ["site_id", "w"], CELL), ["site_id", "w"])
    return area.select("site_id", "w", F.round("area", 4).alias("area_m2"))


@query(
    "g08_erase",
    B.ctes(B.BLOCKS_SQL, B.SITES_SQL, BLOCK_CELLS_SQL, MOVED_SQL)
    + """, c as (select distinct cx*100.0 as x, cy*100.0 as y from block_cells),
 o as (select site_id, sum((least(maxx,x+100)-greatest(minx,x))*(least(maxy,y+100)-greatest(miny,y))) as m2 from moved join c on x<maxx and x+100>minx and y<maxy and y+100>miny group by 1)
 select site_id, round(((maxx-minx)*(maxy-miny)-coalesce(m2,0))/1e4,6) as ha_left from moved left join o using (site_id) where (maxx-minx)*(maxy-miny)-coalesce(m2,0)>1e-6""",
)
def g08(t):
    """Sites across the grid less the union of all (overlapping) blocks."""
    left = O.difference(site_pieces(t), block_pieces(t), ["site_id"], 250.0)
    return O.total(left, ["site_id"]).select("site_id", F.round(F.col("area") / 1e4, 6).alias("ha_left"))


@query(
    "g09_dissolve",
    B.ctes(B.BLOCKS_SQL, BLOCK_CELLS_SQL) + "select kind, count(distinct cx*10000+cy)*1e0 as ha, count(*)*1e0 as ha_double_counted from block_cells group by 1",
)
def g09(t):
    """Overlapping blocks of a kind, dissolved on a grid that they don't fit."""
    union = O.total(O.union(O.fragments(block_shapes(t), ["kind"], 130.0), ["kind"], 130.0), ["kind"])
    each = O.areas(O.fragments(block_shapes(t), ["kind", "block_id"], 130.0), ["kind"])
    return union.select("kind", F.round(F.col("area") / 1e4, 6).alias("ha")).join(each.select("kind", F.round(F.col("area") / 1e4, 6).alias("ha_double_counted")), "kind")


@query(
    "g09_union_across_grid",
    B.ctes(B.BLOCKS_SQL) + "select block_id, round(2*(maxx-minx)*(maxy-miny)-(maxx-minx-37)*(maxy-miny-41),4) as area_m2 from blocks",
)
def g09_across(t):
    """Each block with its copy 37 m east and 41 m north."""
    b = B.blocks(t).select("block_id", "minx", "miny", "maxx", "maxy")
    both = rings(b.unionByName(moved(b)), "block_id").select("block_id", "rings")
    area = O.total(O.union(O.fragments(both, ["block_id"], CELL), ["block_id"], CELL), ["block_id"])
    return area.select("block_id", F.round("area", 4).alias("area_m2"))


@query(
    "g10_overlap_share",
    B.ctes(B.BLOCKS_SQL, B.SITES_SQL, MOVED_SQL)
    + """select site_id, block_id, (least(s.maxx,b.maxx)-greatest(s.minx,b.minx))*(least(s.maxy,b.maxy)-greatest(s.miny,b.miny)) as area_m2,
 round(least(100, 100*(least(s.maxx,b.maxx)-greatest(s.minx,b.minx))*(least(s.maxy,b.maxy)-greatest(s.miny,b.miny))/((s.maxx-s.minx)*(s.maxy-s.miny))),4) as pct
 from moved s join blocks b on s.minx<b.maxx and b.minx<s.maxx and s.miny<b.maxy and b.miny<s.maxy""",
)
def g10(t):
    sites = site_pieces(t)
    size = O.areas(sites, ["site_id"]).withColumnRenamed("area", "size")
    both = O.overlap_areas(sites, ["site_id"], block_pieces(t, "block_id"), ["block_id"], 250.0).join(size, "site_id")
    return both.select(
        "site_id", "block_id", F.round("area", 3).alias("area_m2"),
        F.round(F.least(F.lit(100.0), 100 * F.col("area") / F.col("size")), 4).alias("pct"),
    )


@query(
    "g10_overlap_of_triangles",
    B.ctes(B.SITES_SQL)
    + """, d as (select site_id, maxx-minx as s, site_id%7*37.0 as a, site_id%5*41.0 as b from sites)
 select site_id, round(pow(s-a-b,2)/2,4) as area_m2 from d where s-a-b>0""",
)
def g10_triangles(t):
    """Each site's lower left triangle against its square moved by up to 222 and 164 m; what only meets at a border is left out."""
    pt = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    tri = F.array(F.array(pt("minx", "miny"), pt("maxx", "miny"), pt("minx", "maxy"), pt("minx", "miny")))
    s = B.sites(t)
    dx, dy = F.col("site_id") % 7 * 37.0, F.col("site_id") % 5 * 41.0
    squares = s.withColumn("rings", G.rect_rings(F.col("minx") + dx, F.col("miny") + dy, F.col("maxx") + dx, F.col("maxy") + dy))
    a = O.fragments(s.select("site_id", tri.alias("rings")), ["site_id"], CELL)
    b = O.fragments(squares.select(F.col("site_id").alias("other"), "rings"), ["other"], CELL)
    return O.overlap_areas(a, ["site_id"], b, ["other"], CELL).filter("site_id = other").select("site_id", F.round("area", 4).alias("area_m2"))


@query(
    "g11_opening",
    B.ctes(B.BLOCKS_SQL) + "select block_id, cast(((maxx-minx)/100)*((maxy-miny)/100) as bigint)-4 as n_cells from blocks where maxx-minx>=300 and maxy-miny>=300",
)
def g11(t):
    """A rectangle of three cells and more each way survives opening by a disc of one cell but for its four corners."""
    opened = R.opening(R.runs_of(block_cover(t), ["block_id"]), ["block_id"], 1)
    return R.size_of(opened, ["block_id"])


@query(
    "g12_parts",
    B.ctes(B.BLOCKS_SQL) + "select block_id, 2::bigint as n_parts, ((maxx-minx)*(maxy-miny)+10000)/10000 as ha, (maxx-minx)*(maxy-miny)/10000 as largest_ha from blocks",
)
def g12(t):
    """Each block plus a detached one-cell outlier: two parts, the block is the larger."""
    far = B.blocks(t).select("block_id", F.lit(-50).alias("cx"), F.lit(-50).alias("cy"))
    runs = R.runs_of(block_cover(t).select("block_id", "cx", "cy").unionByName(far), ["block_id"])
    sizes = R.size_of(R.parts(runs, ["block_id"]), ["block_id", "part"])
    return sizes.groupBy("block_id").agg(
        F.count(F.lit(1)).alias("n_parts"), F.sum("n_cells").cast("double").alias("ha"), F.max("n_cells").cast("double").alias("largest_ha")
    )


@query(
    "g13_fill_holes",
    B.ctes(B.SITES_SQL) + "select site_id, cast(((maxx-minx)/100)*((maxy-miny)/100) as bigint) as n_cells, cast(((maxx-minx)/100)*((maxy-miny)/100) as bigint)-1 as n_before from sites",
)
def g13(t):
    df = rings(B.sites(t), "site_id")
    hole = G.rect_rings(F.col("minx") + 100, F.col("miny") + 100, F.col("minx") + 200, F.col("miny") + 200)
    runs = R.runs_of(K.cover(df.withColumn("rings", F.concat("rings", hole)), ["site_id"], CELL), ["site_id"])
    runs = cut_lineage(runs)
    n = R.size_of(R.fill_holes(runs, ["site_id"], 1.5), ["site_id"])
    return n.join(R.size_of(runs, ["site_id"]).withColumnRenamed("n_cells", "n_before"), "site_id")


@query(
    "g14_reach_cells",
    B.ctes(B.AMENITIES_SQL)
    + """, d as (select id%40 as origin, gx.o+cast(floor(x/100) as int) as cx, gy.o+cast(floor(y/100) as int) as cy, x, y, least(1200.0, 60+(id%20)*40.0) as r from amenities, (select unnest(range(-13,14)) as o) gx, (select unnest(range(-13,14)) as o) gy where 60+(id%20)*40.0>60)
 select origin, count(distinct cx*100000+cy) as n_cells from d where sqrt(pow((cx+0.5)*100-x,2)+pow((cy+0.5)*100-y,2))<=r group by 1""",
)
def g14(t):
    """Union of walk discs around reached stops, radius = walk left (60 m to 1200 m)."""
    reached = B.amenities(t).withColumn("origin", F.col("id") % 40).withColumn("walk", 60 + (F.col("id") % 20) * 40.0).filter("walk > 60")
    cells = K.disc_cells(reached, ["origin"], F.col("x"), F.col("y"), F.least(F.lit(1200.0), F.col("walk")), CELL).distinct()
    return cells.groupBy("origin").agg(F.count(F.lit(1)).alias("n_cells"))


@query(
    "g15_centroid",
    B.ctes(B.SITES_SQL) + "select site_id, (minx+maxx)/2 as cx, (miny+maxy)/2 as cy, (minx+maxx)/2 as mx, (miny+maxy)/2 as my from sites",
)
def g15(t):
    df = rings(B.sites(t), "site_id")
    (cx, cy), (mx, my) = G.centroid(F.col("rings")), G.vertex_mean(F.col("rings"))
    return df.select("site_id", F.round(cx, 4).alias("cx"), F.round(cy, 4).alias("cy"), F.round(mx, 4).alias("mx"), F.round(my, 4).alias("my"))


@query(
    "g17_only_polygons",
    B.ctes(B.SITES_SQL) + "select site_id, 'multipolygon' as kind from sites where site_id%3=0 or site_id%3=1",
)
def g17(t):
    from landgauge.sources.features import only_polygons

    kinds = F.element_at(F.array(F.lit("polygon"), F.lit("multipolygon"), F.lit("point")), (F.col("site_id") % 3 + 1).cast("int"))
    df = rings(B.sites(t), "site_id").withColumn("kind", kinds)
    return only_polygons(df).select("site_id", "kind")


@query(
    "g19_line_measures",
    B.ctes(B.SITES_SQL)
    + """select site_id, round(sqrt(pow(maxx-minx,2)+pow(maxy-miny,2))+(maxy-miny),4) as length, (minx+maxx)/2 as mx, miny as my,
 90e0 as bearing, 45e0 as axis_gap from sites""",
)
def g19(t):
    pt = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    df = B.sites(t).withColumn("line", F.array(pt("minx", "miny"), pt("maxx", "maxy"), pt("maxx", "miny")))
    mx, my = G.line_midpoint(F.col("line"))
    b1 = G.bearing(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("miny"))
    b2 = G.bearing(F.col("maxx"), F.col("maxy"), F.col("minx"), F.col("miny"))
    return df.select(
        "site_id", F.round(G.line_length(F.col("line")), 4).alias("length"), mx.alias("mx"), my.alias("my"),
        F.round(b1, 6).alias("bearing"), F.round(G.axis_gap(b1, b2), 6).alias("axis_gap"),
    )
