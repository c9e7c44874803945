"""The five-column feature record and its geometry rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgauge.functions.clean import stable_id

POLYGON_KINDS = ("polygon", "multipolygon")


def only_polygons(df: DataFrame, kind: str = "kind", rings: str = "rings") -> DataFrame:
    """Drops other geometry types and empty shapes; single polygons become multi."""
    return df.filter(F.col(kind).isin(*POLYGON_KINDS) & (F.size(rings) > 0)).withColumn(kind, F.lit("multipolygon"))


def emit_features(
    df: DataFrame, dataset: str, name: Column, props: dict[str, Column], geom: Column, source_id: Column | None = None
) -> DataFrame:
    """dataset, source_id, name, props (JSON without nulls), geom_wkt; empty shapes are dropped."""
    fallback = stable_id(dataset, geom)
    sid = F.coalesce(F.nullif(F.trim(source_id.cast("string")), F.lit("")), fallback) if source_id is not None else fallback
    return df.filter(F.coalesce(geom, F.lit("")) != "").select(
        F.lit(dataset).alias("dataset"),
        sid.alias("source_id"),
        F.nullif(F.trim(name), F.lit("")).alias("name"),
        F.to_json(F.struct(*[c.alias(n) for n, c in props.items()]), {"ignoreNullFields": "true"}).alias("props"),
        geom.alias("geom_wkt"),
    )
