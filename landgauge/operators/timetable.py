"""Timetable measures over calls (trip, seq, stop, minute).

Per-trip work starts from one row per trip and stop, so a trip with endless
calls costs no more than its distinct stops; hourly and per-minute windows run
on counts, never on raw calls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgauge.operators.ordering import exact_quantiles, first_per, next_rows

DAY_HOURS = (7, 18)
PEAK_HOURS = (7, 9)


def expand_frequencies(freq: DataFrame) -> DataFrame:
    """trip, start for every run of a headway row (start, end, headway in minutes)."""
    runs = F.sequence("start", F.col("end") - 1, F.col("headway"))
    return freq.filter((F.col("headway") > 0) & (F.col("end") > F.col("start"))).select("trip", F.explode(runs).alias("minute"))


def stop_frequency(calls: DataFrame, route: str, keys: Sequence[str] = ("stop",), most_routes: int | None = None) -> DataFrame:
    """Trips, daytime departures, departures per hour, and the routes by name (all, unless a limit is given)."""
    day = F.col("hour").between(*DAY_HOURS)
    base = calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("trips_day"), F.count_if(day).alias("deps_day"))
    names = calls.select(*keys, route).distinct()
    top = names if most_routes is None else first_per(names, keys, [F.col(route)], most_routes)
    lists = top.groupBy(*keys).agg(F.array_sort(F.collect_list(route)).alias("routes"))
    n_hours = DAY_HOURS[1] - DAY_HOURS[0] + 1
    return base.join(lists, list(keys)).withColumn("per_hour", F.round(F.col("deps_day") / n_hours, 2))


def link_load(calls: DataFrame) -> DataFrame:
    """Trips per unordered pair of consecutive stops; repeated stops in a row count once."""
    pairs = next_rows(calls.select("trip", "seq", "stop"), ["trip"], "seq", "seq", ["stop"]).filter(
        F.col("next_stop").isNotNull() & (F.col("next_stop") != F.col("stop"))
    )
    return pairs.groupBy(F.least("stop", "next_stop").alias("lo"), F.greatest("stop", "next_stop").alias("hi")).agg(
        F.count(F.lit(1)).alias("trips"), F.count_distinct("trip").alias("n_trips")
    )


def trip_stops(calls: DataFrame, order: str = "seq", cols: Sequence[str] = ()) -> DataFrame:
    """One row per trip and stop: first and last position (and columns at the first)."""
    return calls.groupBy("trip", "stop").agg(
        F.min(order).alias("first_seq"), F.max(order).alias("last_seq"), *[F.min_by(c, order).alias(c) for c in cols]
    )


def onward_pairs(stops: DataFrame, cols: Sequence[str] = ()) -> DataFrame:
    """(trip, stop, dest) for distinct stops where dest is called at after stop."""
    to = stops.select("trip", F.col("stop").alias("dest"), F.col("last_seq").alias("dest_seq"), *[F.col(c).alias(f"dest_{c}") for c in cols])
    return stops.join(to, "trip").filter((F.col("dest") != F.col("stop")) & (F.col("dest_seq") > F.col("first_seq")))


def station_connectivity(calls: DataFrame, key_cities: Sequence[str]) -> DataFrame:
    """Departures, peak, first and last, distinct onward stops and key-city hits per stop."""
    base = calls.groupBy("stop").agg(
        F.count(F.lit(1)).alias("departures"), F.count_if(F.col("hour").between(*PEAK_HOURS)).alias("peak"),
        F.min("minute").alias("first_dep"), F.max("minute").alias("last_dep"),
    )
    direct = onward_pairs(trip_stops(calls)).select("stop", "dest").distinct()
    reach = direct.groupBy("stop").agg(
        F.count(F.lit(1)).alias("destinations"), F.count_if(F.col("dest").isin(*key_cities)).alias("key_cities")
    )
    return base.join(reach, "stop", "left").na.fill(0, ["destinations", "key_cities"])


def hour_histogram(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, counts: departures per daytime hour in order, zero-filled."""
    hours = range(DAY_HOURS[0], DAY_HOURS[1] + 1)
    return calls.groupBy(*keys).agg(F.array(*[F.count_if(F.col("hour") == h) for h in hours]).alias("counts"))


def sustained_tph(calls: DataFrame, keys: Sequence[str], k: int = 1) -> DataFrame:
    """The (k+1)-th quietest daytime hour, and the busiest hour's count."""
    return hour_histogram(calls, keys).select(
        *keys, F.sort_array("counts")[k].alias("sustained"), F.array_max("counts").alias("busiest")
    )


def directional_tph(calls: DataFrame, keys: Sequence[str], bearing: Column, k: int = 1) -> DataFrame:
    """Sustained hour per side of the main axis, best and worst, and the frequency test.

    The axis is half the mean angle of the doubled bearings; a departure is on
    the side of its nearer axis end.
    """
    b = F.radians(bearing)
    with_b = calls.withColumn("_b", b)
    axis = with_b.groupBy(*keys).agg((F.atan2(F.sum(F.sin(2 * F.col("_b"))), F.sum(F.cos(2 * F.col("_b")))) / 2).alias("_axis"))
    side = F.when(F.cos(F.col("_b") - F.col("_axis")) >= 0, 0).otherwise(1)
    sides = with_b.join(axis, list(keys)).withColumn("side", side)
    hours = range(DAY_HOURS[0], DAY_HOURS[1] + 1)

    def hist(cond: Column) -> Column:
        return F.sort_array(F.array(*[F.count_if((F.col("hour") == h) & cond) for h in hours]))[k]

    out = sides.groupBy(*keys).agg(
        hist(F.lit(True)).alias("sustained"), hist(F.col("side") == 0).alias("_a"), hist(F.col("side") == 1).alias("_b2")
    )
    best, worst = F.greatest("_a", "_b2"), F.least("_a", "_b2")
    return out.select(
        *keys, "sustained", best.alias("best_dir"), worst.alias("worst_dir"), ((F.col("sustained") >= 4) | (best >= 2)).alias("meets_frequency")
    )


def busiest_window(calls: DataFrame, keys: Sequence[str], width: int = 59) -> DataFrame:
    """Most departures in [t, t+width] and the earliest such t, from per-minute counts."""
    per = calls.groupBy(*keys, "minute").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("minute").rangeBetween(0, width)
    run = per.withColumn("_in", F.sum("_n").over(w))
    return run.groupBy(*keys).agg(F.max("_in").alias("busiest"), F.min_by("minute", F.struct(-F.col("_in"), F.col("minute"))).alias("starts_at"))


def station_links(calls: DataFrame) -> DataFrame:
    """Direct pairs: trains, and the median minutes of all rides.

    Past-midnight rides gain a day; rides over ten hours are dropped.
    """
    stops = trip_stops(calls, cols=("minute",))
    ride = F.col("dest_minute") - F.col("minute")
    pairs = onward_pairs(stops, ("minute",)).withColumn("_mins", F.when(ride < 0, ride + 1440).otherwise(ride)).filter(F.col("_mins") <= 600)
    trains = pairs.groupBy("stop", "dest").agg(F.count(F.lit(1)).alias("trains_day"))
    mins = exact_quantiles(pairs.select("stop", "dest", "_mins"), ["stop", "dest"], {"m": F.col("_mins")}, {"m": ("m", None)})
    return trains.join(mins.select("stop", "dest", F.col("m_med").alias("minutes")), ["stop", "dest"])
