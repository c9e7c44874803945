"""Loading rules for parquet tables: replace, upsert, insert, patch, stamp, page, export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landgauge.operators.ordering import first_per


class EmptyImport(RuntimeError):
    pass


def replace_dataset(df: DataFrame, path: str, key: str = "dataset", min_rows: int = 1) -> None:
    """Replaces whole datasets of a partitioned table; refuses an import below min_rows.

    Only the partitions present in the import are overwritten.
    """
    if len(df.limit(min_rows).select(F.lit(1)).take(min_rows)) < min_rows:
        raise EmptyImport(f"import for {path} has fewer than {min_rows} rows")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str], order: str, by_order: bool = False) -> DataFrame:
    """Last write wins, inside the batch and against the table.

    With `by_order` the order column alone decides, so late batches may arrive in any order.
    """
    tagged = base.withColumn("_new", F.lit(0)).unionByName(delta.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in tagged.columns if c not in (*keys, "_new")]
    return (
        tagged.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(order, "_new") if by_order else F.struct("_new", order)).alias("_r"))
        .select(*keys, "_r.*")
    )


def insert_ignore(base: DataFrame, delta: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    fresh = first_per(delta, keys, order)
    return base.unionByName(fresh.join(base.select(*keys), list(keys), "left_anti"))


def patch_column(base: DataFrame, delta: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """New values of one column for existing keys; nothing is inserted."""
    new = delta.select(*keys, F.col(col).alias("_new"))
    return base.join(new, list(keys), "left").withColumn(col, F.coalesce("_new", col)).drop("_new")


def append_dataset(base: DataFrame, delta: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Adds to a dataset without clearing it; known keys are refreshed."""
    return upsert(base, delta, keys, order)


def stamp_dataset(df: DataFrame, as_of: Column, key: str = "dataset") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("loaded_at", as_of)


def keyset_page(df: DataFrame, key: str, after, limit: int, props: Sequence[str]) -> DataFrame:
    """The next page in key order with only the wanted columns; resume after its largest key."""
    rest = df if after is None else df.filter(F.col(key) > after)
    return rest.select(key, *props).orderBy(key).limit(limit)


def to_feature_collection(df: DataFrame, order: str, limit: int) -> DataFrame:
    """One FeatureCollection document of at most `limit` rows (the viewport's row cap).

    `df` brings source_id, props (a map) and geom_json.
    """
    capped = df.orderBy(order).limit(limit)
    feature = F.struct(
        F.lit("Feature").alias("type"), F.col("source_id").alias("id"), F.col("props").alias("properties"),
        F.from_json("geom_json", "struct<type:string,coordinates:array<double>>").alias("geometry"),
    )
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), F.to_json(feature).alias("f"))))
    body = F.array_join(F.transform(listed, lambda s: s.f), ",")
    return capped.agg(
        F.count(F.lit(1)).alias("n"),
        F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("doc"),
    )


def export_ranked(df: DataFrame, order: Sequence[Column], cols: Sequence[str], path: str, provenance: Sequence[str]) -> None:
    """Sorted CSV part files plus a provenance sidecar; parts are in rank order."""
    df.orderBy(*order).select(*cols).write.mode("errorifexists").csv(f"{path}/rows", header=True)
    spark: SparkSession = df.sparkSession
    spark.createDataFrame([(line,) for line in provenance], "line string").coalesce(1).write.text(f"{path}/about")
