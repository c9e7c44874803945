"""Incremental landing of files into a keyed table of hash buckets.

The table is `data/batch=N/_bucket=B` folders and one small manifest per batch
that tells, for each bucket, the batch that wrote it last. A batch reads and
rewrites only the buckets that its keys fall into and writes its manifest last,
as one file: before that the batch has not happened, after it it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from landgauge.sources.tables import upsert

BUCKETS = 64  # of a table that is new; a manifest has one row per bucket
KEPT_VERSIONS = 2
MANIFEST = "bucket int, written int, buckets int, batch int"


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all manifests (MANIFEST); none for a table that is not there yet."""
    try:
        found = spark.read.schema("bucket int, written int, buckets int").parquet(f"{path}/manifest")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)
    return found.select("bucket", "written", "buckets", F.col("batch").cast("int")) if "batch" in found.columns else spark.createDataFrame([], MANIFEST)


def committed_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that were committed, in order."""
    return sorted(r.batch for r in _manifests(spark, path).select("batch").distinct().collect())


def _version(spark: SparkSession, path: str, number: int) -> dict[int, tuple[int, int]]:
    """bucket -> (batch that wrote it, number of buckets)"""
    return {r.bucket: (r.written, r.buckets) for r in _manifests(spark, path).filter(F.col("batch") == number).collect()}


def _read(spark: SparkSession, path: str, version: dict[int, tuple[int, int]], buckets: Sequence[int]) -> DataFrame | None:
    folders = [f"{path}/data/batch={version[b][0]}/_bucket={b}" for b in buckets if b in version]
    return spark.read.parquet(*folders) if folders else None


def merge_batch(batch: DataFrame, path: str, keys: Sequence[str], order: str, buckets: int = BUCKETS) -> list[int]:
    """Upserts `batch` into the table at `path`; gives the buckets that were rewritten.

    The row of the largest `order` wins, so a batch that is run again, or late, does no harm. `buckets` counts for a new
    table only. An empty batch commits nothing; null keys are keys like any other.
    """
    spark = batch.sparkSession
    done = committed_versions(spark, path)
    version = _version(spark, path, done[-1]) if done else {}
    n = next(iter(version.values()))[1] if version else buckets
    bucket = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    touched = sorted(r[0] for r in batch.select(bucket.alias("b")).distinct().collect())  # one row per bucket at most
    if not touched:
        return []
    number = done[-1] + 1 if done else 0
    held = _read(spark, path, version, touched)
    merged = upsert(batch.limit(0) if held is None else held, batch, keys, order, by_order=True)
    # one task per bucket writes one file, however the rows came
    merged.withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/batch={number}")
    version |= {b: (number, n) for b in touched}
    rows = spark.createDataFrame([(b, w, k) for b, (w, k) in version.items()], "bucket int, written int, buckets int")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={number}")
    return touched


def retire(spark: SparkSession, path: str, keep: int = KEPT_VERSIONS) -> int:
    """Removes bucket folders that the last `keep` versions don't use, and the manifests before those; gives the number of folders."""
    done = committed_versions(spark, path)
    if not done:
        return 0
    used = {(w, b) for number in done[-keep:] for b, (w, _) in _version(spark, path, number).items()}
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    removed = 0
    for number in done[:-keep]:
        fs.delete(hadoop.Path(f"{path}/manifest/batch={number}"), True)
    for status in fs.globStatus(hadoop.Path(f"{path}/data/batch=*/_bucket=*")):
        folder = status.getPath()
        written, b = int(folder.getParent().getName()[6:]), int(folder.getName()[8:])
        if written <= done[-1] and (written, b) not in used:
            removed += bool(fs.delete(folder, True))
    return removed


def stream_upsert(
    stream: DataFrame, path: str, keys: Sequence[str], order: str, checkpoint: str, watermark: tuple[str, str] | None = None, buckets: int = BUCKETS
) -> StreamingQuery:
    """Applies every micro-batch as an upsert of the buckets it touches; old versions are retired.

    A batch goes on from the last committed version, whatever the checkpoint's
    own count, so a fresh checkpoint keeps the table, and a batch that is run
    again after a failure changes nothing.
    """
    if watermark is not None:
        column, delay = watermark
        stream = stream.withWatermark(column, delay).dropDuplicatesWithinWatermark([*keys, order])

    def apply(batch: DataFrame, number: int) -> None:
        merge_batch(batch, path, keys, order, buckets)
        retire(batch.sparkSession, path)

    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """The table after the last committed batch."""
    done = committed_versions(spark, path)
    if not done:
        raise FileNotFoundError(f"no committed table at {path}")
    version = _version(spark, path, done[-1])
    return _read(spark, path, version, sorted(version))
