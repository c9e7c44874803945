"""Iterative graph operators as rounds of joins; every round is written to the shared folder."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgauge.session import cut_lineage, shuffle_width


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component (smallest node of the component).

    Alternating large-star / small-star rewiring: each round is two grouped
    minima, and the rounds grow with the logarithm of the component diameter.
    """
    links = edges.select("u", "v").filter(F.col("u") != F.col("v")).distinct()

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        if larger:
            both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            joined = both.join(low, "u").filter(F.col("v") > F.col("u"))
            return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(low, "u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = low.select("u", F.col("m").alias("v"))
        return moved.unionByName(own).filter("u <> v").distinct()

    seen = None
    while True:
        links = cut_lineage(star(star(links, True), False))
        # one-row fingerprint of the edge set: the same twice means nothing moved
        mark = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).first()
        if mark == seen:
            break
        seen = mark
    if nodes is None:
        nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("_root")), "node", "left").select(
        *nodes.columns, F.coalesce("_root", "node").alias("component")
    )


def shortest_times(
    edges: DataFrame, sources: DataFrame, eps: float = 0.0, limit: Column | None = None
) -> DataFrame:
    """Multi-source shortest time by relaxation: node, dist.

    `edges` u, v, cost (travel u -> v); `sources` node, dist. A round relaxes
    only the edges of nodes improved in the last round and stops when no node
    improves by more than eps; there is no limit on rounds.
    """
    state = cut_lineage(
        sources.groupBy("node").agg(F.min(F.col("dist").cast("double")).alias("dist")).withColumn("fresh", F.lit(True))
    )
    while True:
        reached = (
            state.filter("fresh")
            .join(edges, F.col("node") == F.col("u"))
            .select(F.col("v").alias("node"), (F.col("dist") + F.col("cost")).alias("dist"), F.lit(True).alias("fresh"))
        )
        if limit is not None:
            reached = reached.filter(F.col("dist") <= limit)
        old = F.min(F.when(~F.col("fresh"), F.col("dist")))
        new = F.min(F.when(F.col("fresh"), F.col("dist")))
        merged = (
            state.withColumn("fresh", F.lit(False)).unionByName(reached).groupBy("node").agg(old.alias("_old"), new.alias("_new"))
        )
        better = F.col("_new").isNotNull() & (F.col("_old").isNull() | (F.col("_new") < F.col("_old") - eps))
        state = cut_lineage(
            merged.select("node", F.when(better, F.col("_new")).otherwise(F.col("_old")).alias("dist"), better.alias("fresh"))
        )
        if state.filter("fresh").isEmpty():
            break
    return state.select("node", "dist")


def shortest_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """origin, node, dist, prev, edge: shortest path trees of many origins at once.

    `edges` u, v, cost, edge; `starts` origin, node, limit (longest path worth following).
    """
    state = cut_lineage(
        starts.select(
            "origin", "node", F.lit(0.0).alias("dist"), F.lit(None).cast(dict(edges.dtypes)["u"]).alias("prev"),
            F.lit(None).cast(dict(edges.dtypes)["edge"]).alias("edge"), "limit", F.lit(True).alias("fresh"),
        )
    )
    while True:
        step = (
            state.filter("fresh")
            .select("origin", F.col("node").alias("u"), F.col("dist").alias("_d"), "limit")
            .join(edges, "u")
            .filter(F.col("_d") + F.col("cost") <= F.col("limit"))
            .select("origin", F.col("v").alias("node"), (F.col("_d") + F.col("cost")).alias("dist"), F.col("u").alias("prev"), "edge", "limit", F.lit(True).alias("fresh"))
        )
        # an equal length keeps the path found first, then the lower edge
        best = F.struct("dist", "fresh", "edge")
        state = cut_lineage(
            state.withColumn("fresh", F.lit(False))
            .unionByName(step)
            .groupBy("origin", "node")
            .agg(F.min_by(F.struct("dist", "prev", "edge", "limit", "fresh"), best).alias("_b"))
            .select("origin", "node", "_b.*")
        )
        if state.filter("fresh").isEmpty():
            break
    return state.drop("limit", "fresh")


def route_pairs(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, edge for every edge on the shortest a-b path no longer than `limit`; `pairs` a, b, limit."""
    starts = pairs.groupBy(F.col("a").alias("origin")).agg(F.max("limit").alias("limit")).withColumn("node", F.col("origin"))
    tree = shortest_paths(edges, starts)
    ends = pairs.filter("a <> b").join(tree.select(F.col("origin").alias("a"), F.col("node").alias("b"), "dist"), ["a", "b"])
    return paths_back(tree, ends.filter(F.col("dist") <= F.col("limit")).select("a", "b"))


def paths_back(tree: DataFrame, ends: DataFrame) -> DataFrame:
    """a, b, edge: the edges between each end b (a, b) and the origin a of its tree (origin, node, prev, edge).

    Pointers are doubled: a node's ancestors 1, 2, 4, ... steps up are tables, as many as the depth has binary digits,
    and from the longest steps to the shortest each place that is reached adds the one that many steps on. A path of 700
    edges takes ten rounds each way.
    """
    up = cut_lineage(tree.filter(F.col("prev").isNotNull()).select("origin", "node", "prev"))
    steps = []
    while not up.isEmpty():
        steps.append(up)
        on = up.select("origin", F.col("node").alias("prev"), F.col("prev").alias("_far"))
        up = cut_lineage(up.join(on, ["origin", "prev"]).select("origin", "node", F.col("_far").alias("prev")))
    at = ends.select("a", "b", F.col("b").alias("node"))
    for step in reversed(steps):
        far = at.join(step.select(F.col("origin").alias("a"), "node", "prev"), ["a", "node"]).select("a", "b", F.col("prev").alias("node"))
        at = cut_lineage(at.unionByName(far))
    used = tree.filter(F.col("prev").isNotNull()).select(F.col("origin").alias("a"), "node", "edge")
    return at.join(used, ["a", "node"]).select("a", "b", "edge")


def assign_load(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """edge, trains, busiest pair: every pair's trains put on the edges of its path.

    `pairs` a, b, trains, straight (straight-line metres); detours are bounded.
    """
    bounded = pairs.withColumn("limit", F.greatest(1.6 * F.col("straight"), F.col("straight") + 3000))
    on = route_pairs(edges, bounded.select("a", "b", "limit")).join(pairs.select("a", "b", "trains"), ["a", "b"])
    return on.groupBy("edge").agg(
        F.sum("trains").alias("trains"), F.max_by(F.struct("a", "b"), F.struct("trains", -F.col("a"), -F.col("b"))).alias("_t")
    ).select("edge", "trains", F.col("_t.a").alias("top_a"), F.col("_t.b").alias("top_b"))


def snap_links(edges: DataFrame, pairs: DataFrame, nodes: DataFrame, reach: float = 60.0) -> DataFrame:
    """Stop pairs routed on a road graph: a, b, metres, n_edges; unreachable pairs are left out.

    `pairs` a, b, ax, ay, bx, by; `nodes` node, x, y. Both ends snap to the
    nearest road node in reach, and the detour is bounded.
    """
    from landgauge.operators.spatial import nearest

    stops = pairs.select(F.col("a").alias("stop"), F.col("ax").alias("sx"), F.col("ay").alias("sy")).union(pairs.select("b", "bx", "by")).dropDuplicates(["stop"])
    snapped = nearest(stops, "stop", nodes, "node", reach).select("stop", "node")
    straight = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    ends = (
        pairs.join(snapped.select(F.col("stop").alias("a"), F.col("node").alias("na")), "a")
        .join(snapped.select(F.col("stop").alias("b"), F.col("node").alias("nb")), "b")
        .withColumn("limit", F.greatest(2.5 * straight, straight + 400))
    )
    wanted = ends.groupBy(F.col("na").alias("a"), F.col("nb").alias("b")).agg(F.max("limit").alias("limit"))
    legs = route_pairs(edges, wanted).join(edges.groupBy("edge").agg(F.min("cost").alias("cost")), "edge")
    total = legs.groupBy(F.col("a").alias("na"), F.col("b").alias("nb")).agg(F.sum("cost").alias("metres"), F.count(F.lit(1)).alias("n_edges"))
    return ends.join(total, ["na", "nb"]).filter(F.col("metres") <= F.col("limit")).select("a", "b", "metres", "n_edges")


# ---- transit ---------------------------------------------------------------

# Minutes to board by mode, to alight, and the walking model.
BOARD_MIN = {"tube": 2.5, "dlr": 3.0, "elizabeth-line": 3.5, "tram": 4.0}
BOARD_OTHER, ALIGHT_MIN = 5.0, 2.0
INTERCHANGE_M, INTERCHANGE_MIN, DETOUR, WALK_M_PER_MIN = 400.0, 1.0, 1.25, 80.0


def transit_graph(hops: DataFrame, rail: DataFrame, stops: DataFrame) -> DataFrame:
    """u, v, cost over line nodes (L:line:stop) and stop nodes (S:stop).

    `hops` line, mode, a, b, minutes; `rail` a, b, minutes, trains; `stops` stop, x, y.
    """
    from landgauge.operators.spatial import within_distance

    def line_node(stop: str) -> Column:
        return F.concat(F.lit("L:"), F.col("line"), F.lit(":"), F.col(stop))

    def stop_node(stop: str) -> Column:
        return F.concat(F.lit("S:"), F.col(stop))

    ride = hops.select(line_node("a").alias("u"), line_node("b").alias("v"), F.col("minutes").cast("double").alias("cost"))
    back = ride.select(F.col("v").alias("u"), F.col("u").alias("v"), "cost")
    served = hops.select("line", "mode", F.explode(F.array("a", "b")).alias("stop")).distinct()
    wait = F
    for mode, minutes in BOARD_MIN.items():
        wait = wait.when(F.col("mode") == mode, F.lit(minutes))
    board = served.select(stop_node("stop").alias("u"), line_node("stop").alias("v"), wait.otherwise(F.lit(BOARD_OTHER)).alias("cost"))
    alight = served.select("line", "stop").distinct().select(line_node("stop").alias("u"), stop_node("stop").alias("v"), F.lit(ALIGHT_MIN).alias("cost"))
    known = stops.select(F.col("stop"))
    direct = (
        rail.filter("minutes > 0")
        .join(known.withColumnRenamed("stop", "a"), "a", "left_semi")
        .join(known.withColumnRenamed("stop", "b"), "b", "left_semi")
        .select(stop_node("a").alias("u"), stop_node("b").alias("v"), (F.col("minutes") + F.least(F.lit(10.0), 540.0 / F.greatest("trains", F.lit(1)))).alias("cost"))
    )
    other = stops.select(F.col("stop").alias("to"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    near = within_distance(stops, other, INTERCHANGE_M, ("x", "y"), ("tx", "ty")).filter(F.col("stop") != F.col("to"))
    walk = near.select(stop_node("stop").alias("u"), stop_node("to").alias("v"), (INTERCHANGE_MIN + F.col("dist") * DETOUR / WALK_M_PER_MIN).alias("cost"))
    return ride.unionByName(back).unionByName(board).unionByName(alight).unionByName(direct).unionByName(walk)


PT_WALK_MPM = 80 / 1.3
ACCESS_M, TRANSFER_M = 1200.0, 300.0


def footpaths(stops: DataFrame, radius: float = TRANSFER_M) -> DataFrame:
    """stop, to, walk (whole seconds) between different stops in transfer reach."""
    from landgauge.operators.spatial import within_distance

    other = stops.select(F.col("stop").alias("to"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    return (
        within_distance(stops.select("stop", "x", "y"), other, radius, ("x", "y"), ("tx", "ty"))
        .filter(F.col("stop") != F.col("to"))
        .select("stop", "to", F.floor(F.col("dist") / PT_WALK_MPM * 60).alias("walk"))
    )


def rides(connections: DataFrame, budget: int) -> DataFrame:
    """dep, td, arr, ta: the rides by one trip from dep at td to arr at ta (budget at most) that no later start from dep gets there as early.

    A trip can be left at any connection that starts no earlier than the one it was boarded at.
    """

    def best(df: DataFrame, keys: list[str]) -> DataFrame:
        """Only rows that arrive earlier than all that start later."""
        least = df.groupBy(*keys, "td").agg(F.min("ta").alias("ta"))
        later = Window.partitionBy(*keys).orderBy(F.col("td").desc()).rowsBetween(Window.unboundedPreceding, -1)
        least = least.withColumn("_later", F.min("ta").over(later))
        return least.filter(F.col("_later").isNull() | (F.col("ta") < F.col("_later"))).drop("_later")

    off = best(connections.filter(F.col("ta") <= budget), ["trip", "arr"]).withColumnRenamed("td", "_off")
    on = connections.select("trip", "dep", "td").distinct()
    return best(on.join(off, "trip").filter(F.col("_off") >= F.col("td")), ["dep", "arr"])


def earliest_arrival(
    origins: DataFrame, stops: DataFrame, connections: DataFrame, t0: int, budget: int,
    access: float = ACCESS_M, transfer: float = TRANSFER_M,
) -> DataFrame:
    """origin, stop, t: earliest arrival (seconds after t0) within the budget.

    `origins` origin, x, y; `connections` trip, dep, arr, td, ta. A round boards
    every trip at its earliest reachable connection, rides on, and walks on to
    nearby stops; it ends when nothing improves. What a stop leads to is the same
    for all origins and worked out once (see `rides`), so no origin meets a trip.
    The rows of an origin stay in one task, which sums up its arrivals itself.
    """
    from landgauge.operators.spatial import within_distance

    walkable = within_distance(origins.select("origin", "x", "y"), stops.select("stop", F.col("x").alias("tx"), F.col("y").alias("ty")), access, ("x", "y"), ("tx", "ty"))
    walkable = walkable.select("origin", "stop", F.floor(F.col("dist") / PT_WALK_MPM * 60).alias("t"), F.lit(True).alias("fresh")).filter(F.col("t") <= budget)
    width = shuffle_width(origins.sparkSession)
    state = cut_lineage(walkable.repartition(width, "origin"))
    inside = connections.filter(F.col("td").between(t0, t0 + budget)).select("trip", "dep", "arr", (F.col("td") - t0).alias("td"), (F.col("ta") - t0).alias("ta"))
    onward = cut_lineage(rides(cut_lineage(inside), budget))
    paths = cut_lineage(footpaths(stops, transfer))
    while True:
        ride = (
            state.filter("fresh").join(onward, F.col("stop") == F.col("dep")).filter(F.col("t") <= F.col("td"))
            .groupBy("origin", F.col("arr").alias("stop")).agg(F.min("ta").alias("t"))
        )
        walk = ride.join(paths, "stop").select("origin", F.col("to").alias("stop"), (F.col("t") + F.col("walk")).alias("t")).filter(F.col("t") <= budget)
        found = ride.unionByName(walk).withColumn("fresh", F.lit(True))
        old, new = F.min(F.when(~F.col("fresh"), F.col("t"))), F.min(F.when(F.col("fresh"), F.col("t")))
        merged = state.withColumn("fresh", F.lit(False)).unionByName(found).repartition(width, "origin").groupBy("origin", "stop").agg(old.alias("_o"), new.alias("_n"))
        better = F.col("_n").isNotNull() & (F.col("_o").isNull() | (F.col("_n") < F.col("_o")))
        state = cut_lineage(merged.select("origin", "stop", F.when(better, F.col("_n")).otherwise(F.col("_o")).alias("t"), better.alias("fresh")))
        if state.filter("fresh").isEmpty():
            break
    return state.select("origin", "stop", "t")


def rail_hops(reached: DataFrame, links: DataFrame, budget: int) -> DataFrame:
    """origin, station, t: reached stations plus one direct train with its expected wait.

    `reached` origin, station, t (seconds); `links` a, b, minutes, trains.
    """
    wait = F.least(F.lit(1800.0), 0.5 * 12 * 3600 / F.greatest(F.col("trains") * 0.6, F.lit(1.0)))
    base = reached.filter(F.col("t") < budget)
    on = base.join(links, F.col("station") == F.col("a")).select("origin", F.col("b").alias("station"), (F.col("t") + wait + F.col("minutes") * 60).alias("t")).filter(F.col("t") < budget)
    return base.select("origin", "station", F.col("t").cast("double").alias("t")).unionByName(on).groupBy("origin", "station").agg(F.min("t").alias("t"))


def rail_access(points: DataFrame, key: str, stations: DataFrame, links: DataFrame, reach: float = 1500.0) -> tuple[DataFrame, DataFrame]:
    """(gateways, feeders): stations in walking reach per point, and the fastest
    direct link of every other station into one of them."""
    from landgauge.operators.spatial import within_distance

    near = within_distance(points, stations.select("sid", "sx", "sy"), reach, ("x", "y"), ("sx", "sy"))
    gateways = near.groupBy(key, "sid").agg(F.min("dist").alias("walk_m"))
    into = links.join(gateways.select(key, F.col("sid").alias("b")), "b")
    best = into.groupBy(key, "a").agg(F.min_by(F.struct("b", "minutes", "trains"), F.struct("minutes", "b")).alias("_l"))
    feeders = best.select(key, F.col("a").alias("sid"), F.col("_l.b").alias("via"), F.col("_l.minutes").alias("minutes"), F.col("_l.trains").alias("trains"))
    return gateways, feeders.join(gateways.select(key, "sid"), [key, "sid"], "left_anti")


def contract(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Degree-2 contraction: chains between kept or branching nodes become single edges.

    `edges` u, v, length (undirected). Each round merges a maximal set of
    non-adjacent pass-through nodes, chosen by a hash priority.
    """
    cur = cut_lineage(
        edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "length").filter("u <> v")
    )
    for i in itertools.count():
        ends = cur.select(F.col("u").alias("node"), F.col("v").alias("other"), "length").unionByName(
            cur.select(F.col("v").alias("node"), F.col("u").alias("other"), "length")
        )
        inner = (
            ends.groupBy("node")
            .agg(
                F.count(F.lit(1)).alias("deg"), F.min("other").alias("a"), F.max("other").alias("b"),
                F.sum("length").alias("length"),
            )
            .filter((F.col("deg") == 2) & (F.col("a") != F.col("b")))
            .join(keep.select("node"), "node", "left_anti")
        )
        # a pass-through node may go this round only if no pass-through neighbour outranks it
        prio = inner.select(F.col("node"), "a", "b", "length", F.xxhash64(F.col("node"), F.lit(i)).alias("p"))
        ranks = prio.select(F.col("node").alias("n"), F.col("p").alias("np"))
        side = prio.select("node", "p", F.explode(F.array("a", "b")).alias("n")).join(ranks, "n")
        lost = side.filter((F.col("np") > F.col("p")) | ((F.col("np") == F.col("p")) & (F.col("n") > F.col("node"))))
        gone = cut_lineage(prio.join(lost.select("node"), "node", "left_anti"))
        if gone.isEmpty():
            break
        drop = gone.select("node")
        left = cur.join(drop.withColumnRenamed("node", "u"), "u", "left_anti").join(
            drop.withColumnRenamed("node", "v"), "v", "left_anti"
        )
        made = gone.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "length")
        cur = cut_lineage(left.select("u", "v", "length").unionByName(made))
    return cur


def unordered(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b))
