import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from landgauge.llm import linededup, queries

SPACES = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def expected(rows, least=10):
    held = Counter(k for _, text in rows for k in {key(x) for x in (text or "").split("\n")})
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or held[key(x)] < least]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def tuples(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=repr)


def test_perfect_hash_numbers_every_key_once():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 63, 1000, 50_000):
        hashes = np.frombuffer(rng.bytes(16 * n), linededup.HASH)
        table = linededup.PerfectHash.build(hashes)
        assert sorted(table.number(hashes).tolist()) == list(range(n))
        assert len(table.bits) * 64 <= max(256, 8 * n)
    others = np.frombuffer(rng.bytes(16 * 1000), linededup.HASH)
    number = table.number(others)
    marks = np.zeros(n, np.uint32)
    marks[table.number(hashes)] = linededup.fingerprint(hashes)
    assert not (marks[number] == linededup.fingerprint(others))[number >= 0].any()


def test_small_documents_against_brute_force_and_sql(spark, documents):
    got = tuples(queries.op13_line_dedup(spark, "/root/testdata/sf0.001"))
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert got == expected(rows) and sum(r[2] for r in got) > 0
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    assert sorted(con.execute(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({queries.OP13_SQL})").fetchall(), key=repr) == got


def test_counts_across_packets_shards_and_copies(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f" Line {i}\t" for i in range(60)] + ["É", "é", "", "  "]
    rows = [(i, "\n".join(rng.choice(vocabulary[: 4 + i % 60]) for _ in range(rng.randint(0, 8)))) for i in range(300)]
    rows += [(1, "all the same\nrare")] * 9 + [(None, "ALL THE SAME \r\nother"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    monkeypatch.setattr(linededup, "SHARD_LINES", 100)
    assert tuples(linededup.line_digests(docs)) == expected(rows)
    assert tuples(linededup.line_digests(docs, 300)) == expected(rows, 300)


def test_odd_rows(odd_docs, empty_docs):
    wide = odd_docs.withColumn("digest", F.lit("clash")).withColumn("gone", F.lit(1)).withColumn("shard", F.lit(2))
    assert tuples(linededup.line_digests(wide, 2)) == expected([(r.doc_id, r.text) for r in odd_docs.collect()], 2)
    assert linededup.line_digests(empty_docs).count() == 0
    assert linededup.drop_common_lines(empty_docs).columns == ["doc_id", "text", "n_lines", "n_dropped"]
