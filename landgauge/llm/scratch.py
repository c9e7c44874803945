"""Written intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from landgauge.session import configure, cut_lineage

# whole texts can be long, so a batch that goes to Python holds fewer rows than Spark's default
BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> SparkSession:
    """The session with the settings that the operators assume."""
    configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """The rows written to a fresh table in the shared folder, read back."""
    return cut_lineage(df)


def width(spark: SparkSession) -> int:
    """How many partitions a shuffle of this session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
