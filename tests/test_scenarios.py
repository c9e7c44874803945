"""Scenario fixtures: low-value land, parcel pairing, rents, readers, loading rules."""

import pytest
from pyspark.sql import functions as F

from landgauge.functions import classify as C
from landgauge.functions import geometry as G
from landgauge.operators import aggregates as A
from landgauge.operators import filters as P
from landgauge.operators import gates as GT
from landgauge.operators import linkage as L
from landgauge.sources import tables as TB
from landgauge.sources import text as TX

LOW_VALUE = [
    ("high-street shop", {"building": "retail", "name": "Corn Exchange"}, 5000, False, False, None),
    ("department store", {"shop": "department_store", "building": "retail"}, 9000, True, True, None),
    ("city retail district", {"landuse": "retail"}, 14000, True, False, None),
    ("large retail district, big car park", {"landuse": "retail", "name": "Ferry Meadow"}, 16000, True, True, "osm_retail/retail_park"),
    ("named retail park", {"landuse": "retail", "name": "Elm Lane Retail Park"}, 1200, False, False, "osm_retail/retail_park"),
    ("shed without car park", {"building": "retail"}, 2000, False, False, None),
    ("shed with car park", {"building": "retail"}, 2000, True, False, "osm_retail/retail"),
    ("small shed with car park", {"building": "retail"}, 1400, True, False, None),
    ("estate tagged retail", {"landuse": "retail", "name": "Quayside Trading Estate"}, 20000, True, True, "osm_industrial/business_park"),
    ("mixed name stays retail", {"landuse": "retail", "name": "Weir Lane Retail & Business Park"}, 20000, True, True, "osm_retail/retail_park"),
    ("three storeys", {"building": "retail", "building:levels": "3"}, 9000, True, True, None),
    ("eleven metres", {"building": "warehouse", "height": "11 m"}, 9000, True, True, None),
    ("two storeys", {"building": "warehouse", "building:levels": "2"}, 9000, False, False, "osm_industrial/warehouse"),
    ("depot", {"landuse": "depot"}, 2000, False, False, "osm_storage/depot"),
    ("gasholder", {"man_made": "gasometer"}, 2000, False, False, "osm_storage/gasometer"),
    ("scrap yard", {"industrial": "scrap_yard", "landuse": "industrial"}, 2000, False, False, "osm_storage/scrap_yard"),
    ("quarry", {"landuse": "quarry"}, 2000, False, False, "osm_brownfield/quarry"),
    ("golf", {"leisure": "golf_course"}, 90000, False, False, "osm_leisure_lowdensity/golf_course"),
    ("allotments", {"landuse": "allotments"}, 9000, False, False, None),
    ("park", {"leisure": "park"}, 9000, False, False, None),
    ("underground parking", {"amenity": "parking", "parking": "underground"}, 9000, False, False, None),
    ("surface parking", {"amenity": "parking"}, 1500, False, False, "osm_parking/surface"),
    ("park and ride", {"amenity": "parking", "park_ride": "yes"}, 1500, False, False, "osm_parking/park_and_ride"),
    ("business park commercial", {"landuse": "commercial", "name": "Heron Business Park"}, 1500, False, False, "osm_industrial/business_park"),
    ("plain commercial", {"landuse": "commercial"}, 1500, False, False, None),
]


def test_low_value_cases(spark):
    rows = spark.createDataFrame(LOW_VALUE, "label string, tags map<string,string>, area int, near boolean, big boolean, want string")
    got = rows.select("label", "want", C.classify_low_value(F.col("tags"), F.col("area"), F.col("near"), F.col("big")).alias("got")).collect()
    assert [(r.label, r.got) for r in got] == [(r.label, r.want) for r in got]


def test_parcels_go_to_owners_inside_them_then_to_the_nearest_left_over(spark):
    """Triangles on a diagonal: titles decide inside, distance decides outside, size and reach bound the rescue."""
    def triangle(x, y, w, h):
        return [[{"x": x, "y": y}, {"x": x + w, "y": y}, {"x": x, "y": y + h}, {"x": x, "y": y}]]

    shapes = [("shared", 0.0, 0.0, 80.0, 60.0), ("wanted", 400.0, 400.0, 30.0, 90.0), ("beyond", 800.0, 800.0, 40.0, 40.0), ("estate", 1200.0, 1200.0, 500.0, 240.0), ("idle", 2500.0, 2500.0, 20.0, 20.0)]
    rows = [(n, triangle(float(x), float(y), w, h), w * h / 2, float(x), float(y)) for n, x, y, w, h in shapes]
    parcels = spark.createDataFrame(rows, "parcel_id string, rings array<array<struct<x: double, y: double>>>, area double, px double, py double")
    owners = [
        ("few", 10.0, 10.0, 1, True), ("most", 20.0, 20.0, 4, True), ("tied", 12.0, 31.0, 4, True), ("leasehold", 5.0, 5.0, 9, False),
        ("near", 391.0, 388.0, 1, True), ("nearer", 400.0, 391.0, 1, True), ("too far", 800.0, 769.0, 2, True), ("by the estate", 1190.0, 1195.0, 1, True),
    ]
    points = spark.createDataFrame(owners, "id string, x double, y double, titles_land int, has_land boolean")
    got = {(r.parcel_id, r.id, r.match, r.match_dist_m) for r in L.pair_parcels(points, parcels, 75.0).collect()}
    assert got == {("shared", "most", "contains", None), ("wanted", "nearer", "nearest", 9.0)}


def test_rents_scenario(spark):
    wide = spark.createDataFrame(
        [("2020-01-01", "E06000001", "100", "1,000"), ("2025-01-01", "E06000001", "132", "1320"), ("2025-01-01", "E06000002", "[x]", "[z]"), ("2025-01-01", "Notes", "1", "1")],
        "period string, area_code string, idx string, rent string",
    )
    long = TX.unpivot_series(wide, ["period", "area_code"], {"index": "idx", "rent": "rent"}, "area_code", r"^[EWSNK]\d{8}$")
    vals = {(r.period, r.area_code, r.series): r.value for r in long.collect()}
    assert vals["2020-01-01", "E06000001", "rent"] == 1000.0 and vals["2025-01-01", "E06000002", "rent"] is None
    assert len(vals) == 6
    obs = long.filter("series = 'rent' and value is not null").withColumn("month", F.to_date("period"))
    packed = A.pack_series(obs, ["area_code"], "month", "value")
    row = packed.select(F.size("values").alias("n"), A.growth_pct(F.col("values"), 60).alias("g")).first()
    assert (row.n, row.g) == (61, 32.0)


def test_delimited_reader_tolerates_messy_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Title row\nNotes, with comma\nArea Code,Name,Rent\nE1,\"Ynys M\xf4n, N\",\"1,200\"\n".encode("cp1252"))
    (tmp_path / "b.tsv").write_bytes("﻿area code\tname\trent\nE2\tCaf\xe9 “x”\t7\n".encode())
    (tmp_path / "c.csv").write_text("<!DOCTYPE html><html>Area Code, error</html>\n")
    got = TX.read_delimited(spark, str(tmp_path), {"code": ["area code"], "name": ["name"], "rent": ["rent"], "extra": ["nope"]})
    rows = {r.code: (r.name, r.rent, r.extra) for r in got.collect()}
    assert rows == {"E1": ("Ynys Môn, N", "1,200", None), "E2": ("Café “x”", "7", None)}


def test_feature_collection_reader(spark, tmp_path):
    doc = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"n":"1"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[2,0],[2,2],[0,2],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}},{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[1,2]}}]}'
    (tmp_path / "f.json").write_text(doc)
    polys = TX.read_feature_collection(spark, str(tmp_path)).select(G.ring_area(F.col("rings")).alias("a")).collect()
    assert sorted(r.a for r in polys) == [0.5, 4.0]
    pts = TX.read_feature_collection(spark, str(tmp_path), TX.POINTS).collect()
    assert [(r.x, r.y) for r in pts] == [(1.0, 2.0)]


def test_replace_refuses_empty_import(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "dataset string, v int")
    TB.replace_dataset(df, f"{tmp_path}/t")
    with pytest.raises(TB.EmptyImport):
        TB.replace_dataset(df.limit(0), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    delta = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, at int")
    once = TB.upsert(base, delta, ["k"], "at")
    twice = TB.upsert(once, delta, ["k"], "at")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a", 1), (2, "d", 3), (3, "e", 1)]


def test_guards_raise(spark):
    df = spark.range(3)
    assert P.require_rows(df, 3, "x").count() == 3
    with pytest.raises(Exception, match="fewer than 4 rows"):
        P.require_rows(df, 4, "x").collect()
    pages = spark.createDataFrame([(1, 1, False), (2, 2, True)], "id int, page int, cut boolean")
    with pytest.raises(Exception, match="cut off"):
        TX.stitch_pages(pages, "id", "page", "cut").collect()


def test_gate_stage_view(spark):
    rows = [(1, 5.0, 10), (2, 1.0, 50), (3, None, 10), (4, 5.0, 90)]
    df = spark.createDataFrame(rows, "id int, conn_pt double, z1_min int")
    gates = [GT.gate("conn", "filter", value=3), GT.gate("z1", "filter", value=30)]
    kept, funnel = GT.run_gates(df, "id", gates)
    assert [r.id for r in kept.collect()] == [1]
    assert [(r.gate, r.before, r.after) for r in funnel.orderBy("step").collect()] == [("conn", 4, 2), ("z1", 2, 1)]
    stage, _ = GT.run_gates(df, "id", gates, stage="conn")
    assert sorted(r.id for r in stage.collect()) == [1, 4]
