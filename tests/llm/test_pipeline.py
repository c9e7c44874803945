from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from landgauge.llm import queries, substring, toxicity
from landgauge.session import cut_lineage
from .conftest import SMALL
from .test_ngram_join import brute
from .test_packing import check_places, expected, tokenizer  # noqa: F401 - a fixture

NAMES = [name for name, _ in corpus_pipeline.STAGES]


@pytest.fixture(scope="module")
def stages(spark, documents):
    """What each stage gets and gives, from the first on."""
    docs, seen = documents, []
    for _, stage in corpus_pipeline.STAGES:
        out = cut_lineage(stage(spark, docs, SMALL))
        seen.append((docs, out))
        docs = out
    return dict(zip(NAMES, seen))


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_keep_the_columns(stages, documents):
    assert NAMES == ["toxicity", "ngram_jaccard_join", "substring_dedup", "mix_sources", "best_fit_packing"]
    for name in NAMES[:-1]:
        assert stages[name][1].columns == documents.columns
        assert stages[name][1].dtypes == documents.dtypes


def test_toxic_documents_go(stages, labels):
    before, after = stages["toxicity"]
    bad = {r.doc_id for r in toxicity.score(before, labels).collect() if r.predicted}
    assert sorted(rows(after)) == sorted(r for r in rows(before) if r[0] not in bad)


def test_one_document_of_each_group_stays(stages):
    before, after = stages["ngram_jaccard_join"]
    keep = {doc for doc, own, _, _ in brute(rows(before)) if doc == own}
    assert sorted(rows(after)) == sorted(r for r in rows(before) if r[0] in keep)


def test_repeats_go(stages):
    before, after = stages["substring_dedup"]
    spans = {}
    for r in substring.repeats(before).filter("removed").collect():
        spans.setdefault(r.doc_id, []).append((r.first_word, r.n_words))
    want = [(d, substring.without(t, spans[d]) if d in spans else t) for d, t in rows(before)]
    assert sorted(rows(after)) == sorted(want)


def test_mixing_keeps_every_document(stages):
    before, after = stages["mix_sources"]
    copies = Counter(rows(after))
    assert set(copies) == set(rows(before))
    assert max(copies.values()) <= 4


def test_packing(stages, tokenizer):  # noqa: F811
    before, after = stages["best_fit_packing"]
    got = after.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == expected(rows(before), tokenizer)
    check_places(got)


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SMALL)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, stages["best_fit_packing"][1].select(columns).collect()))


def test_every_operator_has_a_query(spark):
    numbers = {int(n.split("_")[0][2:]) for n in queries.QUERIES}
    assert numbers == set(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


def test_stages_take_odd_tables(spark, odd_docs, empty_docs, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (6, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    clash = ["id", "key", "row", "spans", "stay", "best", "rate", "copies", "changed", "node", "text_key", "_twice", "_rate", "_key", "_doc", "_spans"]
    wide = odd_docs.withColumns({name: F.lit(name) for name in clash})
    for docs in (odd_docs, empty_docs, wide):
        for _, stage in corpus_pipeline.STAGES:
            docs = cut_lineage(stage(spark, docs, folder))
        assert docs.columns[:2] == ["doc_id", "piece"]


def test_toxic_rows_go_by_their_own_text(spark):
    rows = [(i, "you stupid idiot fool " * 6 if i % 2 else f"the river runs to the sea {i} " * 6) for i in range(60)]
    docs = spark.createDataFrame(rows + [(None, rows[1][1]), (None, rows[2][1]), (2, rows[1][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    kept = sorted(toxicity.drop_toxic(docs, labels).collect(), key=repr)
    assert kept == sorted((r for r in docs.collect() if "river" in r.text), key=repr)
