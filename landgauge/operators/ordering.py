"""Exact ranks, quantiles and neighbours of ordered rows without one-task windows.

A window over a key that holds a third of the rows (or over no key at all)
would sort that whole group in one task. Groups up to HOT_ROWS rows do go
through one ordinary window; larger groups are first cut into value ranges. The
borders are values of sampled rows, so any type that sorts can be cut, and there
are as many as the counted size of the group asks for; each range is summed in
its own task, and the few range totals give the offsets. The result is exact in
both cases; only the cut points depend on the sample. Where no group is that
large (which is counted first), nothing is cut and no join is planned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgauge.session import cut_lineage

# Rows one task may sort for one group.
HOT_ROWS = 4_000_000
HOT_CONF = "landgauge.hotRows"
# A range is meant to hold half of that, and SAMPLES sampled rows tell where it ends.
SAMPLES = 64
# Borders are held by every task up to this many (2 for each HOT_ROWS rows: a million are 2 * 10^12 rows); else they are joined.
MOST_BORDERS = 1_000_000


def hot_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_CONF, str(HOT_ROWS)))


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys and _size of groups with more rows than one task should sort."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    return sizes.filter(F.col("_size") > hot_rows(df))


def range_borders(df: DataFrame, keys: Sequence[str], order: str, hot: DataFrame) -> DataFrame:
    """keys, _borders, _coarse: sorted values that cut each hot group into ranges of about half of HOT_ROWS rows.

    A range ends with its border. `_coarse` has the last border of each block of about the root of their number.
    """
    by = [c for c in hot.columns if c != "_size"]
    ranges = F.ceil(F.col("_size") * 2 / F.lit(hot_rows(df)))
    every = F.greatest(F.floor(F.col("_size") / (ranges * SAMPLES)), F.lit(1))
    hashed = [c for c, kind in df.dtypes if not kind.startswith("map")]
    rows = df.join(hot, by).filter(F.col(order).isNotNull() & (F.pmod(F.xxhash64(*hashed), every) == 0))
    values = rows.groupBy(*keys, order, ranges.alias("_ranges")).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    upto = F.sum("_n").over(group.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    placed = values.withColumn("_part", F.ceil(upto * F.col("_ranges") / F.sum("_n").over(group)))
    ends = placed.filter(F.col("_part") < F.col("_ranges")).groupBy(*keys, "_part").agg(F.max(order).alias("_end"))
    borders = ends.groupBy(*keys).agg(F.sort_array(F.collect_list("_end")).alias("_borders"))
    step = F.ceil(F.sqrt(F.size("_borders"))).cast("int")
    last = F.transform(F.sequence(step, F.size("_borders"), step), lambda i: F.element_at("_borders", i))
    return borders.withColumn("_coarse", F.when(F.size("_borders") >= step, last))


def cut_hot(
    df: DataFrame, keys: Sequence[str], order: str, out: str = "_rng", hot: DataFrame | None = None
) -> DataFrame:
    """Adds a range number of `order` inside hot groups; null elsewhere. Nulls are in the first range.

    `hot` may give the hot groups (with _size) by a subset of the keys when they are cheaper to count.
    """
    keys = list(keys)
    on = keys or ["_all"]
    src = df if keys else df.withColumn("_all", F.lit(0))
    hot = cut_lineage(hot if hot is not None else hot_keys(src, on))
    n = hot.agg(F.sum(F.ceil(F.col("_size") * 2 / F.lit(hot_rows(df))))).first()[0]
    if not n:
        return df.withColumn(out, F.lit(None).cast("int"))
    borders = range_borders(src, on, order, F.broadcast(hot) if n <= MOST_BORDERS else hot)
    key = F.col(order)
    step = F.ceil(F.sqrt(F.size("_borders"))).cast("int")
    block = F.size(F.filter("_coarse", lambda b: b < key))
    place = block * step + F.size(F.filter(F.slice("_borders", block * step + 1, step), lambda b: b < key))
    return (
        src.join(F.broadcast(borders) if n <= MOST_BORDERS else borders, on, "left")
        .withColumn(out, F.when(F.col("_borders").isNotNull(), F.when(key.isNull(), 0).otherwise(place)))
        .select(*df.columns, out)
    )


def range_offsets(
    cut: DataFrame, keys: Sequence[str], sums: dict[str, Column], rng: str = "_rng"
) -> DataFrame:
    """Per hot group and range: `<name>_before` (sum over earlier ranges) and `<name>_all`."""
    keys = list(keys)
    per = (
        cut.filter(F.col(rng).isNotNull())
        .groupBy(*keys, rng)
        .agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    )
    # one row per range: this window is small whatever the data
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    upto = w.orderBy(rng).rowsBetween(Window.unboundedPreceding, 0)
    return per.select(
        *keys,
        rng,
        *[(F.sum(s).over(upto) - F.col(s)).alias(f"{s}_before") for s in sums],
        *[F.sum(s).over(w).alias(f"{s}_all") for s in sums],
    )


def join_offsets(df: DataFrame, offsets: DataFrame, keys: Sequence[str], rng: str = "_rng") -> DataFrame:
    """Left join of the range offsets, one row per range."""
    return df.join(offsets, [*keys, rng], "left")


def cumulative_counts(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, value) -> n_at, n_below, n_total over non-null values, exact at any skew."""
    keys = list(keys)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n_at"))
    )
    cut = cut_hot(counts, keys, value)
    offsets = range_offsets(cut, keys, {"n": F.col("n_at")})
    part = Window.partitionBy(*keys, "_rng")
    upto = part.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = cut.withColumn("_run", F.sum("n_at").over(upto)).withColumn(
        "_tot", F.sum("n_at").over(part)
    )
    return join_offsets(ranked, offsets, keys).select(
        *keys,
        value,
        "n_at",
        (F.coalesce("n_before", F.lit(0)) + F.col("_run") - F.col("n_at")).alias("n_below"),
        F.coalesce("n_all", "_tot").alias("n_total"),
    )


def attach_counts(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds n_at, n_below, n_total of each row's value (null where the value is null)."""
    return df.join(cumulative_counts(df, value, keys), [*keys, value], "left")


def row_numbers(
    df: DataFrame, value: str, tie: str, keys: Sequence[str] = (), out: str = "rn"
) -> DataFrame:
    """1-based row number by (value, tie) over non-null values, plus n_total."""
    keys = list(keys)
    kept = df.filter(F.col(value).isNotNull())
    below = cumulative_counts(kept, value, keys)
    # a hot value is a hot group of its own: its ties are cut by the tie column
    cut = cut_hot(kept, [*keys, value], tie, "_tie_rng")
    offsets = range_offsets(cut, [*keys, value], {"t": F.lit(1)}, "_tie_rng")
    inner = Window.partitionBy(*keys, value, "_tie_rng").orderBy(tie)
    numbered = join_offsets(
        cut.withColumn("_rn", F.row_number().over(inner)), offsets, [*keys, value], "_tie_rng"
    )
    return (
        numbered.join(below, [*keys, value])
        .withColumn(out, F.col("n_below") + F.coalesce("t_before", F.lit(0)) + F.col("_rn"))
        .select(*df.columns, out, "n_total")
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    values: dict[str, Column],
    measures: dict[str, tuple[str, Column | None]],
    probs: dict[str, float] | None = None,
) -> DataFrame:
    """Exact continuous quantiles of several filtered measures per group in one pass.

    `values` names the sorted expressions, `measures` maps an output name to a
    value and an optional row filter (measures over one value share its sort).
    Returns `keys`, `<measure>_n` and `<measure>_<prob name>`.
    """
    probs = probs or {"med": 0.5}
    keys = list(keys)
    vnames = list(values)
    # measures of one value take slots 0, 1, ... of its rows
    slot: dict[str, int] = {}
    used = [0] * len(vnames)
    for m, (v, _) in measures.items():
        slot[m] = used[vnames.index(v)]
        used[vnames.index(v)] += 1
    slots = [f"_f{i}" for i in range(max(used))]

    def flag(v: str, i: int) -> Column:
        for m, (mv, cond) in measures.items():
            if mv == v and slot[m] == i:
                return F.lit(1) if cond is None else F.when(cond, 1).otherwise(0)
        return F.lit(0)

    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("_m"), c.cast("double").alias("_v"), *[flag(v, j).alias(f) for j, f in enumerate(slots)]
            )
            for i, (v, c) in enumerate(values.items())
        ]
    )
    long = (
        df.select(*keys, F.explode(rows).alias("_s"))
        .select(*keys, "_s.*")
        .filter(F.col("_v").isNotNull())
    )
    group = [*keys, "_m"]
    # every row gives at most one row per value, so counting plain rows is enough
    hot = cut_lineage(hot_keys(df.select(*keys), keys) if keys else hot_keys(long, group))
    if hot.limit(1).count():
        # equal values stay in one range, so what is sorted is each value once with its counts
        long = long.groupBy(*group, "_v").agg(*[F.sum(f).alias(f) for f in slots])
        hot = hot if keys else None
    cut = cut_hot(long, group, "_v", hot=hot).withColumn("_h", F.xxhash64(*group, "_rng"))
    offsets = range_offsets(cut, group, {f: F.col(f) for f in slots})
    # the hash leads the sort so that its first eight bytes settle most comparisons
    ordered = Window.partitionBy("_h", *group, "_rng").orderBy("_v")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = cut.select(
        "*",
        *[F.sum(f).over(upto).alias(f"{f}_run") for f in slots],
        *[F.sum(f).over(whole).alias(f"{f}_tot") for f in slots],
    )
    joined = join_offsets(ranked, offsets, group)
    # a row stands for as many ranks as its count says: the two rows a quantile lies between hold the ranks round it
    ranked_slots = joined.withColumns(
        {
            **{f"{f}_rank": F.coalesce(F.col(f"{f}_before"), F.lit(0)) + F.col(f"{f}_run") - 1 for f in slots},
            **{f"{f}_n": F.coalesce(F.col(f"{f}_all"), F.col(f"{f}_tot")) for f in slots},
        }
    )

    def at(f: str, q: float) -> Column:
        return F.lit(q) * (F.col(f"{f}_n") - 1)

    def holds(f: str, rank: Column) -> Column:
        return (rank <= F.col(f"{f}_rank")) & (rank > F.col(f"{f}_rank") - F.col(f))

    hit = F.lit(False)
    for f in slots:
        for q in probs.values():
            hit = hit | holds(f, F.floor(at(f, q))) | holds(f, F.ceil(at(f, q)))
    aggs = []
    for m, (v, _) in measures.items():
        f = slots[slot[m]]
        mine = (F.col("_m") == vnames.index(v)) & (F.col(f) > 0)
        aggs.append(F.coalesce(F.max(F.when(mine, F.col(f"{f}_n"))), F.lit(0)).alias(f"{m}_n"))
        for p, q in probs.items():
            rank = at(f, q)
            lo = F.max(F.when(mine & holds(f, F.floor(rank)), F.col("_v")))
            hi = F.max(F.when(mine & holds(f, F.ceil(rank)), F.col("_v")))
            frac = F.max(F.when(mine & holds(f, F.floor(rank)), rank - F.floor(rank)))
            aggs.append((lo + (hi - lo) * frac).alias(f"{m}_{p}"))
    return ranked_slots.filter(hit).groupBy(*keys).agg(*aggs)


def medians(df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Plain exact medians: `<name>_n`, `<name>_med` per group."""
    return exact_quantiles(df, keys, values, {name: (name, None) for name in values})


def next_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str,
    cols: Sequence[str],
    sides: Sequence[str] = ("next",),
) -> DataFrame:
    """Adds next_<col> (lead) and/or prev_<col> (lag) per key; hot keys are cut into order ranges.

    Ask for both sides in one call: every call reads its input again to size the keys.
    """
    keys = list(keys)
    # ranges are cut by both, so rows of one order value may be in several
    cut = cut_hot(df.withColumn("_at", F.struct(order, tie)), keys, "_at")
    payload = F.struct(*[F.col(c) for c in cols])
    w = Window.partitionBy(*keys, "_rng").orderBy(order, tie)
    at = F.struct(order, tie)
    edges = (
        cut.filter(F.col("_rng").isNotNull())
        .groupBy(*keys, "_rng")
        .agg(F.min_by(payload, at).alias("_head"), F.max_by(payload, at).alias("_tail"))
    )
    by_range = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_rng")
    across = edges.select(
        *keys, "_rng", F.lead("_head").over(by_range).alias("_across_next"), F.lag("_tail").over(by_range).alias("_across_prev")
    )
    steps = {"next": F.lead, "prev": F.lag}
    inside = cut.withColumns({f"_in_{s}": steps[s](payload).over(w) for s in sides})
    joined = join_offsets(inside, across, keys).withColumns(
        {f"_{s}": F.coalesce(f"_in_{s}", f"_across_{s}") for s in sides}
    )
    return joined.select(*df.columns, *[F.col(f"_{s}.{c}").alias(f"{s}_{c}") for s in sides for c in cols])


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, tie: str, value: Column, out: str
) -> DataFrame:
    """Inclusive running sum per key; hot keys are cut into order ranges."""
    keys = list(keys)
    cut = cut_hot(df.withColumn("_val", value).withColumn("_at", F.struct(order, tie)), keys, "_at")
    offsets = range_offsets(cut, keys, {"v": F.col("_val")})
    w = Window.partitionBy(*keys, "_rng").orderBy(order, tie)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return (
        join_offsets(cut.withColumn("_run", F.sum("_val").over(upto)), offsets, keys)
        .withColumn(out, F.col("_run") + F.coalesce("v_before", F.lit(0)))
        .select(*df.columns, out)
    )


def first_per(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None
) -> DataFrame:
    """First k rows per key. Spark trims every map task to k rows per key before the
    shuffle (WindowGroupLimit), so a hot key sends k rows per task, not all of them."""
    name = rank or "_first_rank"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)
