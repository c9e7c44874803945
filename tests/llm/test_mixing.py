import numpy as np
import pytest
from pyspark.sql import functions as F

from landgauge.llm import mixing


def members(spark, seed=0, n=300):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([0.4, 0.4, 0.4], n)
    rows = [(i, int(rng.integers(1, 4)), int(rng.integers(0, 500)), *map(float, p[i])) for i in range(n)]
    rows.append((n, 200, 100, 0.9, 0.05, 0.05))  # a text that is a good part of all tokens
    return spark.createDataFrame(rows, "key long, rows long, tokens long, p_0 double, p_1 double, p_2 double"), rows


@pytest.mark.parametrize("shares", [[0.2, 0.5, 0.3], [0.6, 0.2, 0.2]])
def test_targets_within_reach_are_met(spark, shares):
    table, rows = members(spark)
    rated, target, totals = mixing.fit_rates(table, shares, 0.0, 10.0, False)
    got = {r.key: r.rate for r in rated.collect()}
    want = np.array(shares) * sum(r[1] * r[2] for r in rows)
    sums = [sum(r[1] * r[2] * got[r[0]] * r[3 + k] for r in rows) for k in range(3)]
    assert np.allclose(target, want) and np.allclose(sums, totals) and np.allclose(sums, want, rtol=1e-4)
    assert min(got.values()) >= 0 and max(got.values()) <= 10


def test_targets_out_of_reach_come_as_near_as_projected_gradient_does(spark):
    table, rows = members(spark)
    shares, high = [0.0, 0.0, 1.0], 1.5
    rated, target, totals = mixing.fit_rates(table, shares, 0.0, high, False)
    w = np.array([r[1] * r[2] for r in rows], float)
    p = np.array([r[3:] for r in rows])
    rate, step = np.ones(len(rows)), 1 / np.linalg.eigvalsh((p * w[:, None]).T @ p)[-1]
    for _ in range(20_000):  # a plain projected gradient, run to its end
        rate = np.clip(rate + step * p @ (np.array(target) - (w * rate) @ p), 0, high)
    best = ((np.array(target) - (w * rate) @ p) ** 2).sum()
    assert ((np.array(target) - np.array(totals)) ** 2).sum() <= 1.1 * best


def test_nothing_shrinks_when_all_are_kept(spark):
    table, rows = members(spark)
    rated, target, totals = mixing.fit_rates(table, [0.5, 0.3, 0.2], 1.0, 6.0, True)
    assert rated.agg(F.min("rate")).first()[0] >= 1.0
    assert np.allclose(totals, target, rtol=0.1)  # the posteriors are soft, so one domain overshoots


def test_posteriors_against_plain_naive_bayes(spark):
    docs = [(i, ("red apple pear " if i % 2 else "blue stone rock ") * 3 + f"x{i}") for i in range(40)] + [(90, "red apple"), (91, ""), (92, None), (90, "red apple")]
    labelled = [(i, "fruit" if i % 2 else "stone") for i in range(30)] + [(None, "fruit"), (35, "other")]
    got = mixing.memberships(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labelled, "doc_id long, domain string"), ["fruit", "stone"])
    keys = {r.doc_id: r.key for r in spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", mixing.text_key(F.col("text")).alias("key")).collect()}
    by_key = {r.key: r for r in got.collect()}

    def plain(text):
        counts = {d: {} for d in ("fruit", "stone")}
        for i, d in labelled[:30]:
            for w in docs[i][1].split():
                counts[d][w] = counts[d].get(w, 0) + 1
        logits = []
        for d in ("fruit", "stone"):
            total = sum(counts[d].values()) + mixing.SMOOTHING * mixing.BUCKETS
            lls = [np.log((counts[d].get(w, 0) + mixing.SMOOTHING) / total) for w in text.split()]
            logits.append(np.log(16 / 32) + mixing.EVIDENCE_WORDS * (np.mean(lls) if lls else 0.0))
        e = np.exp(np.array(logits) - max(logits))
        return e / e.sum()

    for i in (0, 1, 33, 90, 91):
        text = dict((d, t) for d, t in docs)[i] or ""
        row = by_key[keys[i]]
        assert np.allclose([row.p_0, row.p_1], plain(text), atol=1e-9)
    assert by_key[keys[90]].rows == 2 and by_key[keys[91]].rows == 2  # the null text counts as empty
    assert by_key[keys[91]].tokens == 0 and by_key[keys[90]].tokens == 2


def test_copies_meet_the_rates(documents, labels):
    lab = labels.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("low").alias("domain"))
    docs = documents.withColumn("rate", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("_rate", F.lit(2))
    rated = mixing.cut(mixing.mix(docs, lab, {"good": 0.5, "low": 0.5}, low=1.0, keep_all=True))
    each = mixing.per_document(docs, rated).collect()
    assert len(each) == documents.count()
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) and abs(sum(r.posterior) - 1) < 1e-9 for r in each)
    copied = mixing.apply_copies(docs.drop("key", "_rate"), rated)
    assert copied.groupBy("doc_id").count().count() == documents.count()
    assert copied.count() == sum(r.copies for r in each)


def test_main_path_is_native(documents, labels):
    lab = labels.select("doc_id", F.lit("good").alias("domain"))
    members = mixing.memberships(documents, lab, ["good", "low"])
    plan = members._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_odd_rows(spark, odd_docs, empty_docs):
    lab = spark.createDataFrame([(1, "a"), (6, "b"), (None, "a"), (5, None)], "doc_id long, domain string")
    got = mixing.per_document(odd_docs, mixing.mix(odd_docs, lab, {"a": 0.5, "b": 0.5})).collect()
    assert len(got) == odd_docs.count()
    assert all(0 <= r.rate <= 4 for r in got)
    assert mixing.mix(empty_docs, lab, {"a": 0.5, "b": 0.5}).count() == 0
    assert mixing.mix(odd_docs, lab.filter("false"), {"a": 0.5, "b": 0.5}).count() == odd_docs.select(mixing.text_key(F.col("text"))).distinct().count()
