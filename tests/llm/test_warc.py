import base64
import hashlib

from pyspark.sql import functions as F

from landgauge.llm import warc
from .conftest import SMALL


def expected(rows):
    top = {}
    for page, _, html in rows:
        payload = (html or "").encode()
        top[payload] = max(top.get(payload, -(1 << 63)), -(1 << 63) if page is None else page)
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        last = top[payload]
        revisit = last != -(1 << 63) and (page is None or page < last)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), digest, "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=repr)


def result(pages):
    read = warc.archive_and_read(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r) for r in read.collect()), key=repr)


def test_round_trip_of_the_small_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    assert result(pages) == expected([(r.page_id, r.url, r.html) for r in pages.collect()])


def test_odd_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    rows = [(i, "http://a.example/x", "same") for i in range(20)]
    rows += [(100, None, None), (101, "", ""), (102, "no url at all\r\nX: y", "a"), (None, "http://b.example:8080/é?q#f", "same"), (103, "http://[bad", "\u0000퟿\r\n\r\n<p>")]
    rows += [(104, "http://c.example/", "x" * 500_000), (104, "http://c.example/", "x" * 500_000)]
    schema = "page_id long, url string, html string"
    pages = spark.createDataFrame(rows, schema)
    assert result(pages) == expected(rows)
    assert result(spark.createDataFrame([], schema)) == []
    wide = pages.withColumn("digest", F.lit("d")).withColumn("surt", F.lit("s")).withColumn("file", F.lit(1))
    assert result(wide) == expected(rows)


def test_lookup_finds_single_captures(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.example/p{i % 13}", f"text {i}") for i in range(200)], "page_id long, url string, html string")
    index = warc.write_index(warc.write_archives(pages))
    wanted = spark.createDataFrame([("http://h3.example/p10", 10), ("http://h3.example/p10", 11), ("http://zzz.example/", 1), ("http://h3.example/p10", 10)], "url string, page_id long")
    found = warc.lookup(index, wanted)
    assert [(r.surt, r.page) for r in found.collect()] == [("example,h3)/p10", 10)]
    assert [bytes(r.payload) for r in warc.read_records(found).collect()] == [b"text 10"]


def test_keys():
    assert warc.surt("https://User@WWW.Example.com:443/A?b=1#c") == "com,example,www)/A?b=1"
    assert warc.surt("http://example.com:81") == "com,example):81"
    assert warc.surt(None) == ""


def test_revisits_name_their_response():
    member = warc.record(5, "http://x.example/", b"body", 9, "2024-01-01T00:00:00Z")
    top, http, payload = warc.parse_record(member)
    assert (top["warc-type"], warc.page_of(top["warc-refers-to"]), payload, http["content-length"]) == ("revisit", 9, b"", "4")
