import random

from pyspark.sql import functions as F

from landgauge.llm import substring
from .conftest import words


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_a_passage_inside_lines_is_found_wherever_it_stands(spark):
    rng = random.Random(5)
    missed, total = 0, 25
    rows, planted = [], {}
    for k in range(total):
        passage = text(rng, 60)
        for j in range(4):
            doc = 100 * k + j
            rows.append((doc, f"{text(rng, rng.randrange(5, 200))} {passage} {text(rng, rng.randrange(5, 200))}\n{text(rng, 40)}"))
            planted[doc] = passage
    rows += [(10_000 + i, text(rng, 300)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.repeats(docs).collect()
    flagged = {r.doc_id for r in got}
    assert not [d for d in flagged if d >= 10_000]
    missed = len({d // 100 for d in planted} - {d // 100 for d in flagged})
    assert missed <= 1
    left = {r.doc_id: r.text for r in substring.drop_repeats(docs).collect()}
    for r in got:
        if r.removed:
            assert planted[r.doc_id] not in left[r.doc_id]
            assert r.kept_doc_id // 100 == r.doc_id // 100 and r.kept_doc_id < r.doc_id
    # what is not part of a passage stays as it was
    for doc, t in rows:
        if doc >= 10_000 or doc % 100 == 0:
            assert left[doc] == t


def test_lines_that_are_nearly_alike_form_one_class(spark):
    rng = random.Random(6)
    base = text(rng, 80).split()
    rows = [(i, " ".join(base[:79] + [f"last{i}"]) + "\n" + text(rng, 30)) for i in range(12)]
    rows.append((50, text(rng, 90)))
    got = [r for r in substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.grain == "paragraph"]
    assert {(r.doc_id, r.kept_doc_id, r.removed) for r in got} == {(i, 0, i > 0) for i in range(12)}


def wrapped(rng, ws, least, most):
    """The words over lines of least to most words each."""
    out = []
    while ws:
        n = rng.randrange(least, most + 1)
        out.append(" ".join(ws[:n]))
        ws = ws[n:]
    return "\n".join(out)


def test_a_passage_over_short_lines_is_found_however_it_is_wrapped(spark):
    rng = random.Random(8)
    rows = []
    for k in range(20):
        passage = text(rng, 64).split()
        rows += [(10 * k + j, f"{wrapped(rng, text(rng, 30).split() + passage + text(rng, 30).split(), 5, 12)}") for j in range(2)]
    got = substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    removed = {r.doc_id: r for r in got if r.removed}
    assert len(removed) >= 19
    assert all(r.kept_doc_id == d - 1 and 20 <= r.n_words <= 64 for d, r in removed.items())
    assert sum(r.n_words for r in removed.values()) >= 0.7 * 64 * 20


def test_a_part_that_stands_in_an_earlier_document_hides_no_passage(spark):
    rng = random.Random(9)
    rows = []
    for k in range(20):
        passage = text(rng, 60)
        phrase = " ".join(passage.split()[21:39])  # too short to count by itself
        rows.append((100 * k, f"{text(rng, 30)} {phrase} {text(rng, 30)}"))
        rows += [(100 * k + j, f"{text(rng, 30)} {passage} {text(rng, 30)}") for j in (1, 2)]
    got = substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    removed = [r for r in got if r.removed]
    assert {(r.doc_id % 100, r.kept_doc_id % 100) for r in removed} == {(2, 1)}
    assert sum(r.n_words for r in removed) >= 0.7 * 60 * 20


def test_repeats_of_the_small_documents(documents):
    rows = {r.doc_id: words(r.text) for r in documents.collect()}
    got = substring.repeats(documents).collect()
    assert got
    for r in got:
        own = rows[r.doc_id][r.first_word : r.first_word + r.n_words]
        kept = rows[r.kept_doc_id][r.kept_word : r.kept_word + r.n_words]
        assert len(own) == r.n_words >= substring.MIN_WORDS
        if r.grain == "passage":
            assert own == kept
        assert r.removed == ((r.doc_id, r.first_word) != (r.kept_doc_id, r.kept_word))


def test_odd_rows(odd_docs, empty_docs):
    assert substring.repeats(empty_docs).count() == 0
    assert substring.drop_repeats(empty_docs).count() == 0
    left = substring.drop_repeats(odd_docs)
    assert left.columns == odd_docs.columns
    assert left.count() == odd_docs.count()
    by_id = {r.doc_id: r for r in left.collect()}
    assert by_id[3].text is None and by_id[2].text == "" and by_id[4].text == "!!! ... ???"
    assert by_id[6].text.startswith("word0 word1")
    assert len(by_id[7].text) < 2000  # nearly all of it stands in document 6
    assert by_id[7].n_chars == len(by_id[7].text)


def test_columns_that_clash(documents):
    wide = documents.withColumn("doc", F.lit(1)).withColumn("at", F.lit("x")).withColumn("key", F.lit(2)).withColumn("_doc", F.lit(3)).withColumn("_spans", F.lit(4))
    assert substring.repeats(wide).count() == substring.repeats(documents).count()
