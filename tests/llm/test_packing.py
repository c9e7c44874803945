import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from landgauge.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


def expected(rows, tokenizer, size=packing.SEQUENCE):
    out = []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), size)):
            part = np.array(ids[at : at + size], "<u4")
            out.append((doc, n, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=repr)


def check_places(rows, size=packing.SEQUENCE):
    """Sequences are gapless, none is too long, and their number is near the fewest possible."""
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert all(e <= size for e in ends.values())
    return len(ends)


def test_small_documents(documents, tokenizer):
    got = packing.pack(documents).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == expected([(r.doc_id, r.text) for r in documents.collect()], tokenizer)
    sequences = check_places(got)
    assert sequences <= sum(r.length for r in got) / packing.SEQUENCE * 1.02 + 1


def test_odd_rows(odd_docs, empty_docs, tokenizer):
    wide = odd_docs.withColumn("length", F.lit("clash")).withColumn("piece", F.lit(1)).withColumn("_g", F.lit(2))
    got = packing.pack(wide, with_ids=True).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == expected([(r.doc_id, r.text) for r in odd_docs.collect()], tokenizer)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got)
    check_places(got)
    assert packing.pack(empty_docs).count() == 0


def test_many_equal_lengths_take_all_slots_once(spark):
    pieces = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.when(F.col("id") % 3 == 0, 100).otherwise(700).cast("long").alias("length"), F.col("id").alias("ids_crc32"))
    got = packing.take_slots(packing.cut(pieces)).collect()
    assert len(got) == 5000
    check_places(got)


def test_ids_equal_the_tokenizers(tokenizer):
    rng = random.Random(7)
    parts = [*"abcST Z'dmlvre .,!?1239éÜßñ\n\t½²ªº\xa0µ<|>-_", "'s", "'re", "'ll", "''", "<|endoftext|>", "İ", "Σ", "日", "é", "\x85", "\x00", "‘", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(4000)]
    encoder = packing.encoder(packing.VOCABULARY)
    for begin in range(0, len(texts), 40):
        some = texts[begin : begin + 40]
        assert [x.tolist() for x in encoder.encode(some)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in some]


def best_fit_decreasing(lengths, size):
    """One document at a time, the plain way."""
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - n)
        else:
            free.append(size - n)
    return len(free)


def test_plan_over_counts_equals_best_fit_over_documents():
    rng = random.Random(8)
    for _ in range(60):
        histogram = {rng.randrange(1, 101): rng.randrange(1, 30) for _ in range(rng.randrange(1, 25))}
        slots = packing.plan(histogram, 100)
        assert sum(s[2] for s in slots) == sum(histogram.values())
        used = max(s[3] + s[2] for s in slots)
        assert used == best_fit_decreasing([n for n, c in histogram.items() for _ in range(c)], 100)
    assert packing.plan({}) == []
    assert len(packing.plan({n: 10**9 + n for n in range(1, 4097)})) < 100_000
