"""Readers for messy text files: delimited, fixed-width, coded records, GeoJSON, GTFS, grids."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landgauge.functions.clean import match_column

# Characters of the 0x80-0x9F range in the common Western code page.
CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_CODES = [0x80, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x8B, 0x8C, 0x8E, 0x91, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0x9B, 0x9C, 0x9E, 0x9F]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (byte offset of the split), pos (increases along a split), line.

    Files that are not valid UTF-8 are decoded as the Western code page; a byte
    order mark is dropped.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        "value",
    )
    bad = spark.read.text(path).filter(~F.is_valid_utf8("value")).select(F.col("_metadata.file_path").alias("file")).distinct()
    west = F.translate(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), "".join(chr(c) for c in CP1252_CODES), CP1252)
    marked = raw.join(bad.withColumn("_bad", F.lit(True)), "file", "left")
    text = F.when(F.col("_bad"), west).otherwise(F.col("value"))
    return marked.select("file", "block", "pos", F.regexp_replace(text, "^﻿", "").alias("line"))


def read_delimited(
    spark: SparkSession, path: str, columns: dict[str, Sequence[str]], contains: bool = True
) -> DataFrame:
    """Canonical string columns from tab- or comma-separated files with preamble rows.

    The header is the first line in which the first canonical column is found,
    however many lines and splits of the file stand before it; files without one (HTML error pages) give no rows. Only
    the few distinct header lines reach the driver. One record per line.
    """
    lines = read_lines(spark, path)
    first_names = next(iter(columns.values()))
    place = F.struct("block", "pos")
    lowered = F.lower("line")
    wanted = F.lit(False)
    for name in first_names:
        wanted = wanted | F.contains(lowered, F.lit(name.lower()))
    is_table = ~F.ltrim("line").startswith("<")
    sep = F.when(F.contains("line", F.lit("\t")), "\t").otherwise(",")
    head = (
        lines.filter(wanted & is_table & (F.size(F.split("line", "[\t,]")) > 1))
        .groupBy("file")
        .agg(F.min(place).alias("_at"), F.min_by("line", place).alias("_head"), F.min_by(sep, place).alias("_sep"))
    )
    parts = []
    for row in head.select("_head", "_sep").distinct().collect():
        names = next(csv.reader([row["_head"]], delimiter=row["_sep"]))
        picks = {canon: match_column(names, cands, contains) for canon, cands in columns.items()}
        if picks[next(iter(columns))] is None:
            continue
        schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
        mine = head.filter((F.col("_head") == row["_head"]) & (F.col("_sep") == row["_sep"]))
        body = lines.join(mine.select("file", "_at"), "file").filter((place > F.col("_at")) & (F.trim("line") != ""))
        parsed = body.select(F.from_csv("line", schema, {"sep": row["_sep"], "mode": "PERMISSIVE"}).alias("r"))
        parts.append(
            parsed.select(
                *[
                    (F.col(f"r.c{names.index(hit)}") if hit else F.lit(None).cast("string")).alias(canon)
                    for canon, hit in picks.items()
                ]
            )
        )
    if not parts:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


POLYGONS, POINTS, ANY = "polygon", "point", "any"
FEATURE = "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>"


def _ring_points(coords: Column) -> Column:
    return F.transform(coords, lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))


def parse_feature(feature: DataFrame, want: str = POLYGONS) -> DataFrame:
    """props, kind, rings (polygons: outer ring first), x, y (points)."""
    g = F.col("f.geometry")
    kind = F.lower(g.type)
    single = F.from_json(g.coordinates, "array<array<array<double>>>")
    multi = F.from_json(g.coordinates, "array<array<array<array<double>>>>")
    spot = F.from_json(g.coordinates, "array<double>")
    # a multi polygon becomes one row per part
    shapes = F.when(kind == "polygon", F.array(single)).when(kind == "multipolygon", multi)
    base = feature.filter(F.col("f").isNotNull() & g.isNotNull()).select(
        F.col("f.properties").alias("props"), kind.alias("kind"), shapes.alias("_shapes"), spot.alias("_spot")
    )
    if want == POLYGONS:
        return base.filter(F.col("_shapes").isNotNull()).select(
            "props", "kind", F.explode("_shapes").alias("_s")
        ).select("props", "kind", _ring_points(F.col("_s")).alias("rings"))
    if want == POINTS:
        return base.filter(F.col("kind") == "point").select("props", "kind", F.get("_spot", F.lit(0)).alias("x"), F.get("_spot", F.lit(1)).alias("y"))
    return base.select("props", "kind")


def read_geojson(spark: SparkSession, path: str, want: str = POLYGONS) -> DataFrame:
    """Newline-separated features (record separators allowed); unreadable lines are skipped."""
    bare = F.regexp_replace("value", "^\x1e", "")
    feature = F.from_json(bare, FEATURE, {"mode": "PERMISSIVE"})
    return parse_feature(spark.read.text(path).filter(F.trim(bare) != "").select(feature.alias("f")), want)


def read_feature_collection(spark: SparkSession, path: str, want: str = POLYGONS) -> DataFrame:
    """Whole FeatureCollection documents, one per file."""
    docs = spark.read.schema(f"features array<struct<{_inline(FEATURE)}>>").json(path, multiLine=True)
    return parse_feature(docs.select(F.explode("features").alias("f")), want)


def _inline(ddl: str) -> str:
    return ddl.replace("type string, properties", "type:string,properties:").replace(": map", ":map").replace(", geometry struct", ",geometry:struct")


# Record slices (start, length; 1-based) of the schedule file.
SCHEDULE_LAYOUT = {
    "BS": {"uid": (4, 6), "runs_from": (10, 6), "runs_to": (16, 6), "days": (22, 7), "status": (30, 1), "stp": (80, 1)},
    "LO": {"tiploc": (3, 7), "depart": (11, 5)},
    "LI": {"tiploc": (3, 7), "arrive": (11, 5), "depart": (16, 5)},
    "LT": {"tiploc": (3, 7), "arrive": (11, 5)},
}


def read_fixed_width(spark: SparkSession, path: str, layout: dict = SCHEDULE_LAYOUT, starts: str = "BS") -> DataFrame:
    """schedule, seq, rec and the sliced fields; a schedule runs from one start record to the next.

    The schedule number is a running count of start records. It is counted per
    file split (a bounded piece) and shifted by the totals of earlier splits.
    """
    lines = read_lines(spark, path).withColumn("rec", F.substring("line", 1, 2)).filter(F.col("rec").isin(*layout))
    opened = F.when(F.col("rec") == starts, 1).otherwise(0)
    per = lines.groupBy("file", "block").agg(F.sum(opened).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("file", "block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("file", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("_run", F.sum(opened).over(inside)).join(base, ["file", "block"])
    fields: dict[str, Column] = {}
    for rec, slices in layout.items():
        for name, (at, n) in slices.items():
            piece = F.when(F.col("rec") == rec, F.trim(F.substring("line", at, n)))
            fields[name] = F.coalesce(fields[name], piece) if name in fields else piece
    return numbered.select(
        "file", (F.col("_before") + F.col("_run")).alias("schedule"), "block", "pos", "rec",
        *[F.nullif(c, F.lit("")).alias(n) for n, c in fields.items()],
    )


def read_coded_records(df: DataFrame, line: str, prefix: str, sep: str, positions: dict[str, int]) -> DataFrame:
    """Separated records that begin with a record code; fields picked by position."""
    parts = F.split(line, "\\Q" + sep + "\\E")
    return df.filter(F.startswith(line, F.lit(prefix + sep))).select(
        *[F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("")).alias(n) for n, i in positions.items()]
    )


# Members and columns of the timetable feed.
GTFS = {
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double",
    "routes": "route_id string, route_short_name string, route_type int",
    "trips": "route_id string, service_id string, trip_id string, shape_id string",
    "stop_times": "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence int",
    "calendar": "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date string, end_date string",
    "calendar_dates": "service_id string, date string, exception_type int",
    "frequencies": "trip_id string, start_time string, end_time string, headway_secs int",
    "shapes": "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int",
    "feed_info": "feed_start_date string, feed_end_date string",
}


def read_gtfs(spark: SparkSession, folder: str, members: Sequence[str] = tuple(GTFS), suffix: str = ".txt") -> dict[str, DataFrame]:
    return {
        m: spark.read.csv(f"{folder}/{m}{suffix}", header=True, schema=GTFS[m], enforceSchema=True, mode="PERMISSIVE") for m in members
    }


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z of every cell centre of ESRI ASCII tiles; no-data cells are dropped. One tile per row."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                head, body = {}, []
                for row in bytes(content).decode("ascii").splitlines():
                    parts = row.split()
                    if len(parts) == 2 and parts[0][0].isalpha():
                        head[parts[0].lower()] = float(parts[1])
                    elif parts:
                        body.append(np.array(parts, dtype="float64"))
                z = np.vstack(body)
                cell = head["cellsize"]
                cols = head["xllcorner"] + (np.arange(z.shape[1]) + 0.5) * cell
                rows = head["yllcorner"] + (z.shape[0] - np.arange(z.shape[0]) - 0.5) * cell
                keep = z != head.get("nodata_value", -9999)
                xx, yy = np.meshgrid(cols, rows)
                yield pd.DataFrame({"x": xx[keep], "y": yy[keep], "z": z[keep]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "x double, y double, z double")


# ---- documents and wide tables ---------------------------------------------


def explode_document(df: DataFrame, doc: str, path: str, schema: str, required: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Rows of the array at `path` inside a JSON document; rows missing a required field drop."""
    items = F.from_json(F.get_json_object(F.col(doc), f"$.{path}"), f"array<struct<{schema}>>")
    rows = df.select(*keep, F.explode(items).alias("_r")).select(*keep, "_r.*")
    for name in required:
        rows = rows.filter(F.col(name).isNotNull() & (F.col(name).cast("string") != ""))
    return rows


def stitch_pages(df: DataFrame, id_col: str, order: str, truncated: str | None = None) -> DataFrame:
    """Union of harvested pages, one row per id (first page wins); a cut-off harvest fails the job."""
    cols = [c for c in df.columns if c not in (id_col, truncated)]
    one = df.groupBy(id_col).agg(F.min_by(F.struct(*cols), order).alias("_r")).select(id_col, "_r.*")
    if truncated is None:
        return one
    last = df.agg(F.max_by(truncated, order).alias("cut")).select(
        F.when(F.col("cut"), F.raise_error(F.lit("harvest was cut off at the last page")).cast("boolean")).otherwise(True)
    )
    return one.withColumn("_ok", last.scalar()).filter("_ok").drop("_ok")


SUPPRESSED = ("[x]", "[z]", "")


def unpivot_series(df: DataFrame, keys: Sequence[str], series: dict[str, str], code: str, pattern: str) -> DataFrame:
    """Wide table -> keys, series, value; suppression marks are null and codes must match."""
    coded = df.filter(F.col(code).rlike(pattern)).select(*keys, *[F.col(c).cast("string").alias(n) for n, c in series.items()])
    long = coded.unpivot(list(keys), list(series), "series", "raw")
    text = F.trim("raw")
    value = F.when(~text.isin(*SUPPRESSED), F.replace(text, F.lit(","), F.lit("")).try_cast("double"))
    return long.select(*keys, "series", value.alias("value"))
