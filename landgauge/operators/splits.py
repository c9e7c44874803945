"""Equi-joins on grid cells whose work is the product of both sides' rows of a cell.

Rows and pairs of each cell are counted first. A cell that holds more than LEAF_ROWS
rows or makes more than LEAF_PAIRS pairs is split into as many parts as its count asks
for: its rows get a part number by hash (so points on one spot are split as well) and
what probes the cell is repeated per part. Where no cell is that full, nothing is
repeated and no join is planned for it. Where all cells make many pairs, they are dealt
over as many tasks as the pairs ask for, whatever the bytes of both sides are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgauge.session import cut_lineage, shuffle_width

# Rows of one cell that one task should join, and pairs that it should make.
LEAF_ROWS, LEAF_PAIRS = 200_000, 20_000_000
LEAF_CONF, PAIRS_CONF = "landgauge.leafRows", "landgauge.leafPairs"
# Full cells are held by every task up to this many (they hold more than LEAF_ROWS rows each); else they are joined.
MOST_FULL = 500_000


def split_full(rows: DataFrame, probe: DataFrame, keys: Sequence[str], by: Sequence[str], count_pairs: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, probe) with `_part`: both join on keys and _part as they would on keys, and no part holds much more than LEAF_ROWS rows or makes much more than LEAF_PAIRS pairs.

    `by` are the columns of `rows` whose hash tells the part; `keys` are what both join on. Without
    `count_pairs` only `rows` is counted, for probes that are few per row and dear to make.
    """
    keys = list(keys)
    conf = rows.sparkSession.conf
    leaf, most = int(conf.get(LEAF_CONF, str(LEAF_ROWS))), int(conf.get(PAIRS_CONF, str(LEAF_PAIRS)))
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if count_pairs:
        counted = counted.join(probe.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")), keys)
    else:
        counted = counted.filter(F.col("_n") > leaf).withColumn("_m", F.lit(0))
    pairs = F.col("_n") * F.col("_m").cast("double")
    parts = F.least(F.greatest(F.ceil(F.col("_n") / leaf), F.ceil(pairs / most)), F.col("_n")).cast("int")
    counted = cut_lineage(counted.select(*keys, pairs.alias("_pairs"), parts.alias("_parts")))
    n, total = counted.agg(F.count_if(F.col("_parts") > 1), F.coalesce(F.sum("_pairs"), F.lit(0.0))).first()
    if not n:
        split, asked = rows.withColumn("_part", F.lit(0)), probe.withColumn("_part", F.lit(0))
    else:
        full = counted.filter("_parts > 1").drop("_pairs")
        known = F.broadcast(full) if n <= MOST_FULL else full
        parts = F.coalesce("_parts", F.lit(1))
        split = rows.join(known, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("_parts")
        asked = probe.join(known, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    width = shuffle_width(rows.sparkSession)
    if total > most * 8:
        # a number of tasks that was asked for is kept, where tasks of few bytes would be put together
        tasks = max(width, int(total / most) + 1)
        split, asked = split.repartition(tasks, *keys, "_part"), asked.repartition(tasks, *keys, "_part")
    return split, asked
