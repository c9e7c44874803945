import hashlib

import numpy as np
from pyspark.sql import functions as F

from landgauge.llm import fingerprint as P


def expected(rows):
    """(id, n_chars, sha of the edited text) by plain Python; ids descending, then text, nulls last."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (doc, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        out.append((doc, len(text), hashlib.sha256(P.edited(text, after).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edited_texts_and_likeness(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = P.compare_edited(documents).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == expected(rows)
    texts, prints = dict(rows), {r.doc_id: r.fingerprint for r in got}
    by_text = {}
    for doc, text in rows:
        assert by_text.setdefault(text, prints[doc]) == prints[doc]
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.95
    order = sorted(texts, reverse=True)
    for r in got:
        after = texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        own, other, following = P.signatures([texts[r.doc_id], P.edited(texts[r.doc_id], after), after])
        assert (r.fingerprint, r.edited_fingerprint) == (P.as_text(own), P.as_text(other))
        assert abs(r.near_edited - (own == other).mean()) < 1e-12 and abs(r.near_next - (own == following).mean()) < 1e-12


def test_collision_rate_is_the_generalised_jaccard_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for trial in range(60):
        terms = np.sort(rng.choice(1 << P.TERM_BITS, 300, replace=False))
        a = rng.integers(0, 9, 300)
        b = np.where(rng.random(300) < trial / 60, rng.integers(0, 9, 300), a)
        x, y = (P.sample(terms[w > 0], w[w > 0]) for w in (a, b))
        errors.append((x == y).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.09


def test_long_texts_that_share_no_word_pair_are_not_alike():
    a, b = (" ".join(f"{c}{i}" for i in range(60_000)) for c in "ab")
    x, y = P.signatures([a, b])
    assert (x == y).sum() == 0
    x, y = P.signatures([a, a + " " + b])  # half of the pairs are shared
    assert abs((x == y).mean() - 0.5) < 0.2


def test_odd_rows(odd_docs, empty_docs, spark):
    got = P.compare_edited(odd_docs.withColumn("id", F.lit(1)).withColumn("part", F.lit("x")).withColumn("guest", F.lit(2))).collect()
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == expected(rows)
    assert P.compare_edited(empty_docs).count() == 0
    alone = P.compare_edited(spark.createDataFrame([(5, "abc def ghi")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.near_next) for r in alone] == [(5, 1.0)]
    many = [(i % 3, f"text {i % 5}") for i in range(40)]
    got = P.compare_edited(spark.createDataFrame(many, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == expected(many)
    assert P.fingerprints(odd_docs).count() == odd_docs.count()
