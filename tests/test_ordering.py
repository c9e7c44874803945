"""Range-cut ordering against numpy, with one key holding a third of all rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from landgauge.operators import ordering as O
from landgauge.operators import ranking as R


def skewed(n=900, seed=7):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 30, n))
    # a third of the values are one and the same
    v = np.where(rng.random(n) < 0.33, 50.0, np.round(rng.normal(100, 40, n), 1))
    return pd.DataFrame({"id": np.arange(n), "k": key, "v": v})


def test_cumulative_counts_hot(hot):
    pdf = skewed()
    got = O.cumulative_counts(hot.createDataFrame(pdf), "v", ["k"]).toPandas()
    for row in got.itertuples():
        group = pdf[pdf.k == row.k].v
        assert row.n_at == (group == row.v).sum()
        assert row.n_below == (group < row.v).sum()
        assert row.n_total == len(group)


def test_global_row_numbers_hot(hot):
    pdf = skewed()
    got = O.row_numbers(hot.createDataFrame(pdf), "v", "id").toPandas().sort_values("id")
    want = pdf.sort_values(["v", "id"]).assign(rn=np.arange(1, len(pdf) + 1)).sort_values("id")
    assert got.rn.tolist() == want.rn.tolist()


def test_quantiles_hot(hot):
    pdf = skewed()
    df = hot.createDataFrame(pdf)
    q = O.exact_quantiles(df, ["k"], {"v": F.col("v")}, {"all": ("v", None), "odd": ("v", F.col("id") % 2 == 1)}, {"p25": 0.25, "p90": 0.9}).toPandas()
    for row in q.itertuples():
        g = pdf[pdf.k == row.k]
        assert np.isclose(row.all_p25, np.quantile(g.v, 0.25))
        assert np.isclose(row.all_p90, np.quantile(g.v, 0.9))
        odd = g[g.id % 2 == 1].v
        assert row.odd_n == len(odd)
        if len(odd):
            assert np.isclose(row.odd_p90, np.quantile(odd, 0.9))


def test_next_rows_and_running_total_hot(hot):
    pdf = skewed()
    df = hot.createDataFrame(pdf)
    got = O.next_rows(df, ["k"], "v", "id", ["id"], ("next", "prev")).toPandas().set_index("id").sort_index()
    s = pdf.sort_values(["k", "v", "id"])
    want_next = s.groupby("k").id.shift(-1)
    want_next.index = s.id
    want_prev = s.groupby("k").id.shift(1)
    want_prev.index = s.id
    assert got.next_id.fillna(-1).tolist() == want_next.sort_index().fillna(-1).tolist()
    assert got.prev_id.fillna(-1).tolist() == want_prev.sort_index().fillna(-1).tolist()
    run = O.running_total(df, ["k"], "v", "id", F.col("id"), "tot").toPandas().set_index("id").sort_index()
    want = s.groupby("k").id.cumsum()
    want.index = s.id
    assert run.tot.tolist() == want.sort_index().tolist()


def ranges(df, keys, order):
    cut = O.cut_hot(df, keys, order)
    assert cut.columns == [*df.columns, "_rng"]
    return cut.toPandas()


def test_strings_with_a_long_common_prefix_are_cut(hot):
    pdf = pd.DataFrame({"w": [f"Customer#{i:09d}" for i in range(3000)]})
    got = ranges(hot.createDataFrame(pdf), [], "w")
    sizes = got.groupby("_rng").w.agg(["count", "min", "max"]).sort_index()
    assert sizes["count"].max() <= 40 and (sizes["min"].iloc[1:].to_numpy() > sizes["max"].iloc[:-1].to_numpy()).all()


def test_equal_values_are_cut_by_their_tie(hot):
    pdf = pd.DataFrame({"id": np.arange(2000), "v": 5.0})
    df = hot.createDataFrame(pdf)
    tie = df.select("id", F.struct("v", "id").alias("at"))
    assert ranges(tie, [], "at").groupby("_rng").id.count().max() <= 40
    got = O.running_total(df, [], "v", "id", F.lit(1), "n").toPandas().sort_values("id")
    assert got.n.tolist() == list(range(1, 2001))
    assert O.row_numbers(df, "v", "id").toPandas().sort_values("id").rn.tolist() == list(range(1, 2001))


def test_a_thousand_hot_groups_and_nulls(hot):
    pdf = pd.DataFrame({"k": np.repeat(np.arange(1000), 50), "v": np.tile(np.arange(50.0), 1000)})
    df = hot.createDataFrame(pdf).withColumn("v", F.when(F.col("v") > 3, F.col("v")))
    got = ranges(df, ["k"], "v")
    assert got.groupby("k")._rng.nunique().min() >= 2 and got._rng.notna().all()
    assert (got[got.v.isna()]._rng == 0).all()
    plain = ranges(df.filter("k < 10 and v > 20"), ["k"], "v")
    assert plain._rng.isna().all()


def test_rank_family_matches_pandas(hot):
    pdf = skewed()
    df = hot.createDataFrame(pdf)
    avg = R.avg_rank_pct(df, "v", "p").toPandas().sort_values("id")
    assert np.allclose(avg.p, pdf.v.rank(pct=True))
    cdf = R.ecdf(df, "v", "p").toPandas().sort_values("id")
    assert np.allclose(cdf.p, [(pdf.v <= x).mean() for x in pdf.v])


def test_peers_equal_brute_force(hot):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": range(120), "tier": rng.choice(["a", "b"], 120, p=[0.9, 0.1]), "size": rng.permutation(5000)[:120] + 50})
    got = R.peers(hot.createDataFrame(pdf), "id", "tier", "size", 4).toPandas()
    ls = np.log(pdf["size"].to_numpy(dtype=float))
    for i in pdf.id:
        gap = np.abs(ls - ls[i])
        ok = [(gap[j], j) for j in pdf.id if j != i and (pdf.tier[j] == pdf.tier[i] or gap[j] < 0.25)]
        want = [j for _, j in sorted(ok)[:4]]
        assert got[got.id == i].sort_values("peer_rank").peer.tolist() == want


def test_quantiles_of_few_values_sort_each_value_once(hot):
    """equal values are in one range whatever their number, so they must not be sorted row by row."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": np.arange(3000) % 2, "v": rng.integers(0, 11, 3000) / 100, "w": rng.random(3000)})
    df = hot.createDataFrame(pdf)
    for keys in (["k"], []):
        q = O.exact_quantiles(df, keys, {"v": F.col("v")}, {"all": ("v", None), "some": ("v", F.col("w") < 0.3)}, {"p10": 0.1, "med": 0.5, "p99": 0.99})
        windows = [line for line in q._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line and "_v" in line and "sum(" in line]
        assert windows
        for row in q.collect():
            g = pdf[pdf.k == row.k] if keys else pdf
            for name, values in (("all", g.v), ("some", g[g.w < 0.3].v)):
                assert row[f"{name}_n"] == len(values)
                for p, at in (("p10", 0.1), ("med", 0.5), ("p99", 0.99)):
                    assert abs(row[f"{name}_{p}"] - np.quantile(values, at)) < 1e-12


def test_peers_take_the_list_of_their_size(spark):
    """against brute force, rows without a tier too; no row is paired with the rows it could meet before the best are taken."""
    rng = np.random.default_rng(11)
    rows = [(i, None if i % 17 == 0 else f"t{rng.integers(0, 4)}", int(rng.integers(1, 25))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, tier string, size int")
    ranked = R.peers(df, "id", "tier", "size", 4)
    got = {}
    for r in ranked.collect():
        got.setdefault(r.id, []).append((r.peer_rank, round(r.gap, 12), r.peer))
    for i, tier, size in rows:
        gaps = [(round(abs(np.log(size) - np.log(s)), 12), j) for j, t, s in rows if j != i and (t is not None and t == tier or abs(np.log(size) - np.log(s)) < 0.25)]
        assert sorted(got.get(i, [])) == [(k + 1, g, j) for k, (g, j) in enumerate(sorted(gaps)[:4])]
    top = ranked._jdf.queryExecution().optimizedPlan().toString().splitlines()[:12]
    assert not any("Window" in line for line in top[:3])
