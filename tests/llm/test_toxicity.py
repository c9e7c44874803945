import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from landgauge.llm import toxicity as T

RNG = random.Random(3)
SYLLABLES = ["ka", "lo", "mi", "ne", "ru", "ti", "so", "va", "de", "po"]


def word():
    return "".join(RNG.choice(SYLLABLES) for _ in range(RNG.randrange(1, 4)))


def made(n=600):
    """Ordinary made-up text; one document in five has some words of a family of rare expressions."""
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(RNG.randrange(30, 200))]
        toxic = int(i % 5 == 1)
        if toxic:
            for _ in range(max(2, len(w) // 30)):
                w.insert(RNG.randrange(len(w)), "gruzh" + RNG.choice(SYLLABLES))
        docs.append((i, " ".join(w)))
        labels.append((i, toxic))
    return docs, labels


def test_held_out_documents_are_told_apart(spark):
    docs, labels = made()
    toxic = dict(labels)
    got = T.score(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert sum(r.predicted == toxic[r.doc_id] for r in held) >= 0.95 * len(held)


def brute_ratios(counts, order, d=T.DISCOUNT, low_d=T.LOWER_DISCOUNT):
    """The same Kneser-Ney ratios from dictionaries."""
    full = defaultdict(lambda: [0, 0])
    for w, pair in counts.items():
        s = T.BEGIN + w + T.END
        for i in range(1, len(s)):
            for c in (0, 1):
                full[s[max(0, i - order + 1) : i + 1]][c] += pair[c]
    levels, above = {}, set(full)
    for m in range(order - 1, 0, -1):
        levels[m] = Counter(g[1:] for g in above if len(g) == m + 1)
        above = set(levels[m]) | {g for g in full if len(g) == m}

    def shared(g):
        same = {x: c for x, c in levels[len(g)].items() if x[:-1] == g[:-1]}
        back = 1 / (len(levels[1]) + 1) if len(g) == 1 else shared(g[1:])
        return (max(levels[len(g)][g] - low_d, 0) + low_d * len(same) * back) / sum(same.values())

    out = {}
    for g in full:
        same = [p for x, p in full.items() if x[:-1] == g[:-1]]
        back, logs, left = shared(g[1:]), [], []
        for c in (0, 1):
            total, mass = sum(p[c] for p in same), sum(min(p[c], d) for p in same)
            logs.append(math.log((max(full[g][c] - d, 0) + mass * back) / total if total else back))
            left.append(math.log(mass / total) if total else 0.0)
        if sum(full[g]) > 1:
            out["g" + g] = logs[1] - logs[0]
        out["h" + g[:-1]] = left[1] - left[0]
    return out


def test_ratios_against_plain_dictionaries(spark):
    rows = [("the cat sat on the mat", 0), ("the dog sat on the log idiot", 1), ("a cat and a dog idiot moron", 1), ("that cat that hat", 0)]
    counts = defaultdict(lambda: [0, 0])
    for text, y in rows:
        for w in text.split():
            counts[w][y] += 1
    for order in (3, 5):
        full = T.gram_counts(T.word_counts(spark.createDataFrame(rows, "text string, y int")), order)
        ratios = T.log_ratios(full, order)
        got = {r.key: r.value for r in ratios.collect()}
        want = brute_ratios(counts, order)
        assert set(got) == set(want)
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
        model = T.gather_model(ratios, order)

        def plain(w):
            s, x = T.BEGIN + w + T.END, 0.0
            for i in range(1, len(s)):
                g = s[max(0, i - order + 1) : i + 1]
                x += want.get("g" + g, want.get("h" + g[:-1], 0.0))
            return math.log(T.TOXIC_SHARE * math.exp(x) + 1 - T.TOXIC_SHARE)

        texts = ["idiot cat", "zebra", "", "Moronic DOG, the hat!"]
        ratio, n = model.score_texts(texts)
        assert n.tolist() == [2, 1, 0, 4]
        assert np.allclose(ratio, [sum(plain(w.strip(",!")) for w in t.lower().split()) for t in texts], atol=1e-4)


def test_odd_rows(spark, odd_docs, empty_docs):
    labels = spark.createDataFrame([(1, 1), (6, 0), (7, None), (None, 1), (5, 7), (1, 0), (8, 0)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    got = T.score(odd_docs, labels).collect()
    assert len(got) == odd_docs.count()
    assert all(0 <= r.score <= 1 for r in got)
    none = labels.filter("false")
    assert {r.score for r in T.score(odd_docs, none).collect()} == {0.5}
    assert T.score(empty_docs, labels).count() == 0
    left = T.drop_toxic(odd_docs.withColumn("x", F.lit(1)), labels)
    assert left.columns == [*odd_docs.columns, "x"]


def test_the_curve_exists_for_any_counts():
    assert T.fit_curve([]) == (1.0, 0.0)
    slope, shift = T.fit_curve([(0.0, 90, 0), (0.1, 0, 10)])
    p = [1 / (1 + math.exp(-(slope * x + shift))) for x in (0.0, 0.1)]
    assert p[0] < 0.1 and p[1] > 0.8
    slope, shift = T.fit_curve([(0.0, 5, 0)])
    assert 1 / (1 + math.exp(-shift)) < 0.5


def test_no_log_ratio_is_lost_where_hashes_start_alike(spark, monkeypatch):
    """with 16 slots, nearly every entry shares its slot with others."""
    monkeypatch.setattr(T, "SLOT_BITS", 4)
    counts = {"cat": [5, 1], "idiot": [1, 6], "moron": [2, 4], "hat": [3, 3]}
    words = spark.createDataFrame([(w, *n) for w, n in counts.items()], "word string, n0 long, n1 long")
    model = T.gather_model(T.log_ratios(T.gram_counts(words, 5), 5), 5)
    want = brute_ratios(counts, 5)
    ratio, _ = model.score_texts(list(counts))
    for w, got in zip(counts, ratio):
        s = T.BEGIN + w + T.END
        x = sum(want.get("g" + s[max(0, i - 4) : i + 1], want.get("h" + s[max(0, i - 4) : i], 0.0)) for i in range(1, len(s)))
        assert math.isclose(got, math.log(T.TOXIC_SHARE * math.exp(x) + 1 - T.TOXIC_SHARE), abs_tol=1e-4)


def test_more_log_ratios_than_a_task_holds_are_joined(spark, odd_docs, monkeypatch):
    docs, labels = made(200)
    docs = spark.createDataFrame([*docs, (900, None), (901, ""), (902, "Ünï-gruzhka, GRUZHLO!"), (None, docs[1][1])], "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    held = sorted((r.doc_id or -1, r.score, r.predicted) for r in T.score(docs, labels).collect())
    monkeypatch.setattr(T, "MOST_ENTRIES", 10)
    joined = sorted((r.doc_id or -1, r.score, r.predicted) for r in T.score(docs, labels).collect())
    assert [(r[0], r[2]) for r in held] == [(r[0], r[2]) for r in joined]
    assert all(abs(a[1] - b[1]) < 1e-3 for a, b in zip(held, joined))
    assert T.score(odd_docs, labels).count() == odd_docs.count()
