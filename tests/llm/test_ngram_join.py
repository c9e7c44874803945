import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from landgauge.llm import minhash, ngram_join
from landgauge.llm.components import components
from landgauge.llm.scratch import cut
from .conftest import grams


def brute(rows, threshold=0.8):
    sets = [grams(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    low = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        low[find(i)].append(doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for d in low[find(i)] if d is not None]
        own = doc if not sets[i] else min(ids, default=None)
        out.append((doc, own, len(low[find(i)]) if sets[i] else 1, links[i]))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.class_id, r.class_size, r.n_links) for r in df.collect()), key=repr)


def test_documents_against_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert result(ngram_join.jaccard_join(documents)) == brute(rows)


def test_odd_rows(odd_docs, empty_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert result(ngram_join.jaccard_join(odd_docs)) == brute(rows)
    assert ngram_join.jaccard_join(empty_docs).count() == 0
    assert ngram_join.drop_near_copies(empty_docs).count() == 0
    left = ngram_join.drop_near_copies(odd_docs)
    assert left.columns == odd_docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted([1, 2, 3, 4, 5, 6, 8, None], key=repr)


def near_copies(n, seed=0):
    """Texts of 60 words, each with one word of its own at the end or the start."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(60)]
    return [(i, " ".join([*base, f"own{i}"] if i % 2 else [f"own{i}", *base])) for i in range(n)]


def test_a_hot_group_is_cut_into_blocks_and_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 7)
    rows = near_copies(60) + [(100 + i, t) for i, t in near_copies(5, seed=1)] + [(200 + i, "same old text again and again") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(ngram_join.jaccard_join(docs)) == brute(rows)


def test_columns_that_clash_are_left_alone(documents):
    wide = documents.withColumn("node", F.lit(1)).withColumn("class_id", F.lit("x")).withColumn("_id", F.lit(2)).withColumn("keys", F.lit(3))
    assert result(ngram_join.jaccard_join(wide)) == result(ngram_join.jaccard_join(documents))
    kept = ngram_join.drop_near_copies(wide)
    assert kept.columns == wide.columns
    assert kept.count() == ngram_join.drop_near_copies(documents).count()


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9])
def test_band_plan_reaches_its_recall(threshold):
    bands, rows = minhash.band_plan(threshold, 0.999, 128)
    assert bands * rows <= 128
    assert 1 - (1 - threshold**rows) ** bands >= 0.999


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    got = components(spark.createDataFrame(edges, "u long, v long"), cut).collect()
    roots = {r.node: r.root for r in got}
    assert roots == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 50)}


def test_null_ids_are_linked_by_their_texts(spark):
    """Many near copies without an id: each class is read once, and no row meets all others."""
    base = [f"word{i}" for i in range(60)]
    rows = [(None, " ".join([*base[:-1], f"end{i % 40}"])) for i in range(200)] + [(7, " ".join(base))]
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_size, r.n_links, r.class_id) for r in got} == {(201, 200, 7)}
