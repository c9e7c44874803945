"""Numeric kernels that need an ordered walk along one line: cutting and simplifying."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SNAP_M, LOOK_AHEAD = 120.0, 1500


def cut_pattern(trips: DataFrame, snap_m: float = SNAP_M, ahead: int = LOOK_AHEAD) -> DataFrame:
    """Adds `cut`: for each stop the nearest shape vertex not before the last one.

    `trips` pattern, shape ARRAY<STRUCT<x,y>>, stops ARRAY<STRUCT<x,y>>. The
    walk is a fold over one row's arrays, so patterns spread over all tasks.
    """

    @F.pandas_udf("array<int>")
    def walk(shape: pd.Series, stops: pd.Series) -> pd.Series:
        out = []
        for line, calls in zip(shape, stops):
            v = np.array([(p["x"], p["y"]) for p in line], dtype="float64")
            at, cuts = 0, []
            for p in calls:
                window = v[at : at + ahead]
                gaps = np.hypot(window[:, 0] - p["x"], window[:, 1] - p["y"])
                i = int(gaps.argmin())
                if gaps[i] > snap_m:
                    cuts.append(None)
                    continue
                at += i
                cuts.append(at)
            out.append(cuts)
        return pd.Series(out)

    return trips.withColumn("cut", walk("shape", "stops"))


def _keep(v: np.ndarray, tol: float) -> np.ndarray:
    """Douglas-Peucker mask with an explicit stack."""
    mask = np.zeros(len(v), dtype=bool)
    mask[[0, -1]] = True
    stack = [(0, len(v) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d = v[b] - v[a]
        mid = v[a + 1 : b] - v[a]
        n = np.hypot(*d)
        gap = np.abs(d[0] * mid[:, 1] - d[1] * mid[:, 0]) / n if n > 0 else np.hypot(mid[:, 0], mid[:, 1])
        i = int(gap.argmax())
        if gap[i] > tol:
            k = a + 1 + i
            mask[k] = True
            stack += [(a, k), (k, b)]
    return mask


def simplify_features(df: DataFrame, tol: float, rings: str = "rings", area: str = "area") -> DataFrame:
    """Rings thinned to the tolerance; shapes smaller than two pixels (4 tol^2) are dropped."""

    @F.pandas_udf("array<array<struct<x:double,y:double>>>")
    def thin(col: pd.Series) -> pd.Series:
        out = []
        for shape in col:
            kept = []
            for ring in shape:
                v = np.array([(p["x"], p["y"]) for p in ring], dtype="float64")
                half = len(v) // 2
                # a closed ring is thinned as two open halves
                m = np.concatenate([_keep(v[: half + 1], tol)[:-1], _keep(v[half:], tol)])
                if m.sum() >= 4:
                    kept.append([{"x": x, "y": y} for x, y in v[m]])
            out.append(kept)
        return pd.Series(out)

    return df.filter(F.col(area) > 4 * tol * tol).withColumn(rings, thin(rings)).filter(F.size(rings) > 0)


def infer_lonlat(df: DataFrame, x: str, y: str) -> DataFrame:
    """Adds lng, lat whatever the pair holds: grid metres, lon/lat or lat/lon; null if outside."""
    from landgauge.functions.clean import coordinate_system
    from landgauge.functions.geometry import to_lonlat

    kind = coordinate_system(F.col(x), F.col(y))
    conv = to_lonlat(df.withColumn("_kind", kind), x, y, "_lng", "_lat")

    def choose(grid: str, lonlat: str, latlon: str) -> Column:
        k = F.col("_kind")
        return F.when(k == "grid", F.col(grid)).when(k == "lonlat", F.col(lonlat)).when(k == "latlon", F.col(latlon))

    return conv.withColumn("lng", choose("_lng", x, y)).withColumn("lat", choose("_lat", y, x)).drop("_kind", "_lng", "_lat")
