"""Transport marts: bus network, station timetable, track usage, road traffic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgauge.operators import aggregates as A
from landgauge.operators import linkage as L
from landgauge.operators import spatial as S
from landgauge.operators import timetable as T
from landgauge.operators.filters import active_services, resolve_schedules
from landgauge.operators.graph import assign_load
from landgauge.session import cut_lineage


def bus_network(calls: DataFrame, trips: DataFrame, calendar: DataFrame, exceptions: DataFrame, day: Column) -> tuple[DataFrame, DataFrame]:
    """(stops, links) on the sample day. `calls` trip, seq, stop, minute, hour; `trips` trip, service_id, route."""
    running = trips.join(active_services(calendar, exceptions, day), "service_id", "left_semi")
    used = calls.join(running.select("trip", "route"), "trip")
    return T.stop_frequency(used, "route"), T.link_load(used)


def station_timetable(calls: DataFrame, key_cities: list[str], bearing: Column) -> DataFrame:
    """Connectivity, sustained and directional frequency and the busiest hour per stop."""
    base = T.station_connectivity(calls, key_cities)
    ways = T.directional_tph(calls, ["stop"], bearing)
    peak = T.busiest_window(calls, ["stop"])
    return base.join(ways, "stop").join(peak, "stop")


def track_usage(schedules: DataFrame, calls: DataFrame, day: Column, stations: DataFrame, edges: DataFrame) -> DataFrame:
    """Trains per track section. `schedules` uid, ord, stp, passenger, runs_from, runs_to;
    `calls` ord, seq, stop; `stations` stop, node, x, y; `edges` u, v, cost, edge."""
    used = calls.join(resolve_schedules(schedules, day).select("ord"), "ord", "left_semi").withColumnRenamed("ord", "trip")
    load = T.link_load(used)
    a = stations.select(F.col("stop").alias("lo"), F.col("node").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = stations.select(F.col("stop").alias("hi"), F.col("node").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    pairs = (
        load.join(a, "lo").join(b, "hi").filter("a <> b")
        .groupBy("a", "b").agg(F.sum("trips").alias("trains"), F.min(F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))).alias("straight"))
    )
    return assign_load(edges, pairs)


# How far a link may look for a count on its own road, by class.
COUNT_REACH = {"M": 4000.0, "A": 3000.0, "B": 1500.0}
MINOR_REACH = 25.0


def road_traffic(counts: DataFrame, links: DataFrame, minor_reach: float = MINOR_REACH) -> tuple[DataFrame, DataFrame]:
    """(links with flow, junctions). `counts` point_id, road, x, y, year, flow (one row per year);
    `links` link_id, road, cls, lx, ly, a, b."""
    latest = A.latest_by(counts, ["point_id"], ["year"], ["road", "x", "y", "flow"])
    latest = cut_lineage(latest)
    reach = F
    for cls, r in COUNT_REACH.items():
        reach = reach.when(F.col("cls") == cls, F.lit(r))
    major = L.keyed_nearest(links.filter(F.col("cls").isin(*COUNT_REACH)), latest, "link_id", "point_id", "road", reach.otherwise(F.lit(0.0)))
    minor = S.nearest(links.filter(~F.col("cls").isin(*COUNT_REACH)), "link_id", latest, "point_id", minor_reach, 1, ("lx", "ly"), ("x", "y"))
    hit = major.select("link_id", "point_id").unionByName(minor.select("link_id", "point_id")).join(latest.select("point_id", "flow"), "point_id")
    flowed = links.join(hit.select("link_id", "flow"), "link_id")
    return flowed, A.junction_flow(flowed)
