"""Geometry scalars as Column expressions: projections, distances, areas, bearings.

A polygon is `rings ARRAY<ARRAY<STRUCT<x,y>>>` in metres, closed, outer ring
first; a line is one `ARRAY<STRUCT<x,y>>`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
KX, KY = 111_320.0, 110_540.0

# Airy 1830 and WGS84 axes, national-grid origin, datum shift.
AIRY = (6377563.396, 6356256.909)
WGS84 = (6378137.0, 6356752.314245)
GRID_SCALE, GRID_LAT0, GRID_LON0, GRID_E0, GRID_N0 = 0.9996012717, 49.0, -2.0, 400_000.0, -100_000.0
SHIFT = {"tx": -446.448, "ty": 125.157, "tz": -542.060, "rx": -0.1502, "ry": -0.2470, "rz": -0.8421, "s": 20.4894e-6}


def local_metres(lng: Column, lat: Column, lat0: Column, ky: float = KY) -> tuple[Column, Column]:
    return lng * KX * F.cos(F.radians(lat0)), lat * ky


def haversine_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def _to_cartesian(lng: Column, lat: Column, axes: tuple[float, float]) -> tuple[Column, Column, Column]:
    a, b = axes
    e2 = 1 - b * b / (a * a)
    phi, lam = F.radians(lat), F.radians(lng)
    nu = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    return nu * F.cos(phi) * F.cos(lam), nu * F.cos(phi) * F.sin(lam), (1 - e2) * nu * F.sin(phi)


def _from_cartesian(x: Column, y: Column, z: Column, axes: tuple[float, float]) -> tuple[Column, Column]:
    """Longitude and latitude (Bowring's closed form, sub-millimetre on land)."""
    a, b = axes
    e2, ep2 = 1 - b * b / (a * a), a * a / (b * b) - 1
    p = F.hypot(x, y)
    theta = F.atan2(z * a, p * b)
    phi = F.atan2(z + ep2 * b * F.pow(F.sin(theta), 3), p - e2 * a * F.pow(F.cos(theta), 3))
    return F.degrees(F.atan2(y, x)), F.degrees(phi)


def _shift(x: Column, y: Column, z: Column, sign: float) -> tuple[Column, Column, Column]:
    rx, ry, rz = (math.radians(SHIFT[k] / 3600) * sign for k in ("rx", "ry", "rz"))
    tx, ty, tz = (SHIFT[k] * sign for k in ("tx", "ty", "tz"))
    s = 1 + SHIFT["s"] * sign
    return tx + s * x - rz * y + ry * z, ty + rz * x + s * y - rx * z, tz - ry * x + rx * y + s * z


def _meridian_arc(phi: Column) -> Column:
    a, b = AIRY
    n = (a - b) / (a + b)
    d, s = phi - math.radians(GRID_LAT0), phi + math.radians(GRID_LAT0)
    c = (
        1 + n + 5 / 4 * (n**2 + n**3),
        3 * n + 3 * n**2 + 21 / 8 * n**3,
        15 / 8 * (n**2 + n**3),
        35 / 24 * n**3,
    )
    return b * GRID_SCALE * (
        c[0] * d - c[1] * F.sin(d) * F.cos(s) + c[2] * F.sin(2 * d) * F.cos(2 * s) - c[3] * F.sin(3 * d) * F.cos(3 * s)
    )


def _radii(phi: Column) -> tuple[Column, Column, Column]:
    a, b = AIRY
    e2 = 1 - b * b / (a * a)
    w = 1 - e2 * F.pow(F.sin(phi), 2)
    nu = a * GRID_SCALE / F.sqrt(w)
    rho = a * GRID_SCALE * (1 - e2) / F.pow(w, 1.5)
    return nu, rho, nu / rho - 1


def airy_to_grid(df: DataFrame, lng: str, lat: str, e: str = "e", n: str = "n") -> DataFrame:
    """Published transverse-Mercator series on the Airy ellipsoid.

    The latitude terms are used many times over, so each is a column of its
    own; one nested expression would double in size with every use.
    """
    phi, dl = F.col("_phi"), F.radians(F.col(lng) - GRID_LON0)
    staged = df.withColumn("_phi", F.radians(F.col(lat)))
    nu_c, rho_c, eta_c = _radii(phi)
    staged = (
        staged.withColumns(
            {"_nu": nu_c, "_rho": rho_c, "_eta2": eta_c, "_arc": _meridian_arc(phi), "_s": F.sin(phi), "_c": F.cos(phi)}
        )
        .withColumn("_t2", F.pow(F.col("_s") / F.col("_c"), 2))
        .withColumn("_dl", dl)
    )
    nu, rho, eta2, s, c, t2, d = (F.col(x) for x in ("_nu", "_rho", "_eta2", "_s", "_c", "_t2", "_dl"))
    north = (
        F.col("_arc") + GRID_N0
        + nu / 2 * s * c * F.pow(d, 2)
        + nu / 24 * s * F.pow(c, 3) * (5 - t2 + 9 * eta2) * F.pow(d, 4)
        + nu / 720 * s * F.pow(c, 5) * (61 - 58 * t2 + t2 * t2) * F.pow(d, 6)
    )
    east = (
        GRID_E0
        + nu * c * d
        + nu / 6 * F.pow(c, 3) * (nu / rho - t2) * F.pow(d, 3)
        + nu / 120 * F.pow(c, 5) * (5 - 18 * t2 + t2 * t2 + 14 * eta2 - 58 * t2 * eta2) * F.pow(d, 5)
    )
    return staged.select(*df.columns, east.alias(e), north.alias(n))


def grid_to_airy(df: DataFrame, e: str, n: str, lng: str = "lng", lat: str = "lat", rounds: int = 6) -> DataFrame:
    a, _ = AIRY
    staged = df.withColumn("_phi", (F.col(n) - GRID_N0) / (a * GRID_SCALE) + math.radians(GRID_LAT0))
    for _i in range(rounds):
        phi = F.col("_phi")
        staged = staged.withColumn("_phi", phi + (F.col(n) - GRID_N0 - _meridian_arc(phi)) / (a * GRID_SCALE))
    phi = F.col("_phi")
    nu_c, rho_c, eta_c = _radii(phi)
    staged = staged.withColumns(
        {"_nu": nu_c, "_rho": rho_c, "_eta2": eta_c, "_t": F.tan(phi), "_sec": 1 / F.cos(phi), "_d": F.col(e) - GRID_E0}
    )
    nu, rho, eta2, t, sec, d = (F.col(x) for x in ("_nu", "_rho", "_eta2", "_t", "_sec", "_d"))
    t2 = t * t
    north = (
        phi
        - t / (2 * rho * nu) * F.pow(d, 2)
        + t / (24 * rho * F.pow(nu, 3)) * (5 + 3 * t2 + eta2 - 9 * t2 * eta2) * F.pow(d, 4)
        - t / (720 * rho * F.pow(nu, 5)) * (61 + 90 * t2 + 45 * t2 * t2) * F.pow(d, 6)
    )
    east = (
        math.radians(GRID_LON0)
        + sec / nu * d
        - sec / (6 * F.pow(nu, 3)) * (nu / rho + 2 * t2) * F.pow(d, 3)
        + sec / (120 * F.pow(nu, 5)) * (5 + 28 * t2 + 24 * t2 * t2) * F.pow(d, 5)
        - sec / (5040 * F.pow(nu, 7)) * (61 + 662 * t2 + 1320 * t2 * t2 + 720 * F.pow(t2, 3)) * F.pow(d, 7)
    )
    return staged.select(*df.columns, F.degrees(east).alias(lng), F.degrees(north).alias(lat))


def _change_datum(df: DataFrame, lng: str, lat: str, old, new, sign: float, out: tuple[str, str]) -> DataFrame:
    x, y, z = _to_cartesian(F.col(lng), F.col(lat), old)
    staged = df.withColumns({"_x0": x, "_y0": y, "_z0": z})
    x, y, z = _shift(F.col("_x0"), F.col("_y0"), F.col("_z0"), sign)
    staged = staged.withColumns({"_x": x, "_y": y, "_z": z})
    glng, glat = _from_cartesian(F.col("_x"), F.col("_y"), F.col("_z"), new)
    return staged.select(*df.columns, glng.alias(out[0]), glat.alias(out[1]))


def to_metres(df: DataFrame, lng: str, lat: str, e: str = "e", n: str = "n") -> DataFrame:
    """Adds national-grid metres to WGS84 degrees (seven-parameter shift, about 5 m)."""
    moved = _change_datum(df, lng, lat, WGS84, AIRY, 1.0, ("_alng", "_alat"))
    return airy_to_grid(moved, "_alng", "_alat", e, n).drop("_alng", "_alat")


def to_lonlat(df: DataFrame, e: str, n: str, lng: str = "lng", lat: str = "lat") -> DataFrame:
    """Adds WGS84 degrees to national-grid metres."""
    local = grid_to_airy(df, e, n, "_alng", "_alat")
    return _change_datum(local, "_alng", "_alat", AIRY, WGS84, -1.0, (lng, lat)).drop("_alng", "_alat")


# ---- rings and lines -------------------------------------------------------


def rect_rings(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    def pt(x: Column, y: Column) -> Column:
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    return F.array(F.array(pt(minx, miny), pt(maxx, miny), pt(maxx, maxy), pt(minx, maxy), pt(minx, miny)))


def edges_of(ring: Column) -> Column:
    """Consecutive vertex pairs as structs a, b."""
    n = F.size(ring)
    return F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, v: acc + v)


def signed_ring_area(ring: Column) -> Column:
    return _total(F.transform(edges_of(ring), lambda e: e.a.x * e.b.y - e.b.x * e.a.y)) / 2


def ring_area(rings: Column) -> Column:
    """Outer ring minus holes, m2."""
    sizes = F.transform(rings, lambda r: F.abs(signed_ring_area(r)))
    return sizes[0] * 2 - _total(sizes)


def area_ha(rings: Column) -> Column:
    return ring_area(rings) / 1e4


def envelope(rings: Column) -> Column:
    pts = F.flatten(rings)
    xs, ys = F.transform(pts, lambda p: p.x), F.transform(pts, lambda p: p.y)
    return F.struct(
        F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy")
    )


def expand(box: Column, m: float) -> Column:
    return F.struct(
        (box.minx - m).alias("minx"), (box.miny - m).alias("miny"), (box.maxx + m).alias("maxx"), (box.maxy + m).alias("maxy")
    )


def vertex_mean(rings: Column) -> tuple[Column, Column]:
    """Mean of the outer ring's distinct vertices (the closing one is dropped)."""
    ring = F.slice(rings[0], 1, F.size(rings[0]) - 1)
    n = F.size(ring)
    return _total(F.transform(ring, lambda p: p.x)) / n, _total(F.transform(ring, lambda p: p.y)) / n


def centroid(rings: Column) -> tuple[Column, Column]:
    """Area centroid of the outer ring."""
    e = edges_of(rings[0])
    a6 = signed_ring_area(rings[0]) * 6
    cross = [
        F.transform(e, lambda s: (s.a.x + s.b.x) * (s.a.x * s.b.y - s.b.x * s.a.y)),
        F.transform(e, lambda s: (s.a.y + s.b.y) * (s.a.x * s.b.y - s.b.x * s.a.y)),
    ]
    return _total(cross[0]) / a6, _total(cross[1]) / a6


def line_length(line: Column) -> Column:
    return _total(F.transform(edges_of(line), lambda e: F.hypot(e.b.x - e.a.x, e.b.y - e.a.y)))


def line_midpoint(line: Column) -> tuple[Column, Column]:
    """Midpoint between the end points."""
    a, b = line[0], F.element_at(line, -1)
    return (a.x + b.x) / 2, (a.y + b.y) / 2


def bearing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees clockwise from north."""
    return F.pmod(F.degrees(F.atan2(x2 - x1, y2 - y1)) + 360, F.lit(360.0))


def axis_gap(b1: Column, b2: Column) -> Column:
    """Angle between two undirected axes, 0..90 degrees."""
    d = F.pmod(F.abs(b1 - b2), F.lit(180.0))
    return F.least(d, 180 - d)


def pixel_degrees(zoom: int) -> float:
    return 360 / (256 * 2**zoom)
