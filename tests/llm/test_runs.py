import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from landgauge.llm import queries, runs

COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def brute(words):
    """Every maximal stretch per lag by comparing all pairs of words, kept if its smallest period is the lag."""
    found, n = set(), len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(24, 3 * q):
                piece = words[i : i + length]
                if not any(all(piece[k] == piece[k + d] for k in range(length - d)) for d in range(1, q)):
                    found.add((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def damaged(doc, words):
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if doc is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc, text):
    words = damaged(doc, re.findall("[^\x20\x09-\x0d]+", text or ""))
    found = brute(words)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    digest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc, len(found), *digest, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept))


def tuples(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def made(rng):
    words = []
    for _ in range(rng.randint(1, 6)):
        unit = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))]
        words += unit * rng.randint(1, 9) + unit[: rng.randint(0, len(unit))]
        words += [rng.choice("abxyz") for _ in range(rng.randint(0, 10))]
    return words


@pytest.mark.parametrize("alphabet", ["ab", "abc", "made"])
def test_every_run_of_random_words(alphabet):
    rng = random.Random(alphabet)
    lists = [made(rng) if alphabet == "made" else [rng.choice(alphabet) for _ in range(rng.randint(0, 120))] for _ in range(150)]
    lists += [[], ["a"], ["a"] * 23, ["a"] * 24, ["a", "b"] * 40, (["a"] * 30 + ["b"]) * 5]
    assert runs.runs_of(lists) == [brute(w) for w in lists]


def test_splitting_keeps_every_run_and_ends_at_common_words():
    rng = random.Random(7)
    word = np.array([rng.randint(0, 400) for _ in range(3000)] + [k % 50 for k in range(400)] + [rng.randint(0, 9) for _ in range(100)])
    left = runs.split_segments(word, np.array([0]), np.array([len(word)]))
    assert sum(b - a for a, b in left) < 3000
    for a, b in left:
        assert b - a >= runs.MIN_LENGTH and np.unique(word[a:b], return_counts=True)[1].min() >= runs.MIN_PERIODS
    assert runs.find_runs(word, np.array([0]), np.array([len(word)])) == brute(word.tolist())


def test_long_texts_take_few_tests():
    words = [f"w{i % 20_011}" for i in range(120_000)]
    assert runs.runs_of([words, ["same"] * 200_000]) == [[(0, 120_000, 20_011)], [(0, 200_000, 1)]]


def test_small_documents(spark, documents):
    got = tuples(queries.op11_periodic_runs(spark, "/root/testdata/sf0.001"))
    assert got == sorted((expected(r.doc_id, r.text) for r in documents.collect()), key=repr)


def test_odd_rows(odd_docs, empty_docs):
    wide = odd_docs.withColumn("start", F.lit("clash")).withColumn("runs", F.lit(1)).withColumn("_c", F.lit(2))
    short = wide.filter("text is null or length(text) < 1000")
    assert tuples(runs.run_digests(short)) == sorted((expected(r.doc_id, r.text) for r in short.collect()), key=repr)
    assert runs.run_digests(wide).count() == 10
    assert runs.run_digests(empty_docs).count() == 0 and runs.periodic_runs(empty_docs).count() == 0


def test_words_are_cut_at_ascii_spaces_only(spark):
    text = " x  y\x0bz\x1cz\n" * 30
    got = runs.periodic_runs(spark.createDataFrame([(1, text), (None, text)], "doc_id long, text string")).collect()
    assert [[tuple(x) for x in r.runs] for r in got] == [[(0, 90, 3)]] * 2
    assert {r.collapsed for r in got} == {" x  y z\x1cz"}
