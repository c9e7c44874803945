import zlib

import numpy as np
from pyspark.sql import functions as F

from landgauge.llm import langid


def is_held(doc):
    return zlib.crc32(str(doc).encode()) % 4 == 2


def test_held_out_documents(documents):
    rows = {r.doc_id: r for r in documents.collect()}
    got = langid.identify(documents).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    assert all(r.held_out == is_held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    judged = [r for r in got if r.held_out and rows[r.doc_id].lang]
    right = sum(r.lang_pred == rows[r.doc_id].lang for r in judged)
    assert right >= 0.9 * len(judged)


def test_features_against_a_plain_count():
    (at, count, lettered), (none, _, blank), (empty, _, void) = langid.counts(["Ab, b", "12 3", ""])
    plain = "ab  b"
    assert count.sum() == sum(len(plain) - n + 1 for n in (1, 2, 3)) and lettered
    assert not blank and len(none) and not void and not len(empty)


def test_odd_rows(odd_docs, empty_docs):
    got = {(r.doc_id, r.lang_pred, r.held_out) for r in langid.identify(odd_docs).collect()}
    by_id = {d: (p, h) for d, p, h in got}
    for doc in (2, 3, 4):
        assert by_id[doc][0] == "und"
    assert by_id[None][1] is False
    assert {p for p, _ in by_id.values()} <= {"und", "en", "de", "tr"}
    assert langid.identify(empty_docs).count() == 0
    untaught = langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in untaught} == {("und", 0.0)}


def test_penalties_keep_weights_sparse_and_temperature_calibrates():
    z, n = np.array([[0.00005, 0.5]]), np.array([[1.0, 1.0]])
    w = langid.weights_of(z, n)
    assert w[0, 0] == 0 and w[0, 1] < 0
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 400)
    logits = 8 * np.eye(3)[np.where(rng.random(400) < 0.2, rng.integers(0, 3, 400), y)]
    t = langid.temperature(logits, y)
    assert abs(langid.softmax(logits / t).max(axis=1).mean() - (logits.argmax(axis=1) == y).mean()) < 0.03
