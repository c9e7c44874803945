"""WARC archives with a two-level capture index.

Archives: each task writes its pages as records, one gzip member per record,
to files of its own; a file counts only through the manifest rows that Spark
commits, so a task that is run again leaves an unused file and no doubt.

Index: captures are sorted by (reversed-host key, page id) and written as
compressed blocks of lines. Each index file ends with its sparse directory,
one line per block, and a fixed trailer that tells where the directory is.
Level one is the first capture of each index file (one row per file), level
two the directory; a lookup bisects both and then reads one byte range.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgauge.llm.scratch import cut, width
from landgauge.session import scratch_path

BLOCK_LINES, ARCHIVE_BYTES = 512, 256 << 20
TRAILER = "<QQ8s"
MAGIC = b"CAPIDX01"
# Fixed values of the archive format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
NO_PAGE = -(1 << 63)  # stands for a null page id in keys
CONTROL = re.compile(r"[\x00-\x20\x7f]")

CAPTURE = "surt string, page long, file string, offset long, length long"


def surt(url: str | None) -> str:
    """Reversed-host sort key: https://a.example.net:443/x?y -> net,example,a)/x?y; null gives the empty key."""
    if url is None:
        return ""
    bare = CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url.strip())
    scheme, mark, rest = bare.partition("://")
    if not mark:
        scheme, rest = "", bare
    cut_at = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, path = rest[:cut_at].rpartition("@")[2].lower(), rest[cut_at:].partition("#")[0]
    name, colon, port = host.partition(":")
    if colon and (scheme.lower(), port) not in (("http", "80"), ("https", "443"), (scheme.lower(), "")):
        path = f":{port}{path}"
    return ",".join(reversed(name.split("."))) + ")" + (path or "/")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member: a response, or a revisit of page `refers_to`."""
    http = HTTP_HEAD.format(len(payload)).encode()
    block = http if refers_to is not None else http + payload
    head = [
        VERSION,
        "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(record headers, HTTP headers, payload) of one gzip member; header names in lower case."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")

    def fields(block: bytes) -> dict[str, str]:
        lines = block.decode("utf-8", "surrogatepass").split("\r\n")[1:]
        return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}

    top = fields(head)
    block = rest[: int(top["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return top, fields(http), payload


def page_of(field: str | None) -> int | None:
    digits = (field or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _task_file(folder: str, kind: str, number: int) -> tuple[FileSystem, str, str]:
    """A file name that no other attempt of any task uses."""
    task = TaskContext.get()
    name = f"{folder}/{kind}-{task.stageId()}-{task.partitionId()}-{task.taskAttemptId()}-{number}"
    fs, path = FileSystem.from_uri(name)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs, path, name


def write_archives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0) -> DataFrame:
    """Writes one record per row of `pages` (page_id, url, html) and returns the captures: surt, page, file, offset, length.

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads
    of at least `least_bytes` bytes, those of the largest page_id are
    responses and all others revisit it; smaller payloads are all responses. A
    null page_id ranks below all others.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    first = cut(rows.filter(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max("page").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    dealt = rows.join(first, "digest", "left").select("page", "url", "html", F.when(F.coalesce("page", F.lit(NO_PAGE)) < F.col("kept"), F.col("kept")).alias("kept"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, number, at = None, "", 0, 0
        for batch in batches:
            captures = []
            for page, url, html, kept in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    fs, path, name = _task_file(folder, "pages", number)
                    out, number, at = fs.open_output_stream(path), number + 1, 0
                member = record(page, url, html.encode("utf-8", "surrogatepass"), kept, date)
                out.write(member)
                captures.append((surt(url), NO_PAGE if page is None else page, name, at, len(member)))
                at += len(member)
            if captures:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*captures)], names=["surt", "page", "file", "offset", "length"])
        if out is not None:
            out.close()

    return cut(dealt.mapInArrow(write, CAPTURE))


def write_index(captures: DataFrame) -> DataFrame:
    """Writes the capture index and returns its first level: file, surt, page (the file's first capture)."""
    spark = captures.sparkSession
    folder = scratch_path(spark, "capture-index")
    placed = captures.select("surt", "page", "file", "offset", "length").repartitionByRange(width(spark), "surt", "page").sortWithinPartitions("surt", "page")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at, lines, directory = None, "", 0, [], []

        def flush() -> None:
            nonlocal at, lines
            if lines:
                block = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
                out.write(block)
                directory.append([*lines[0][:2], at, len(block)])
                at, lines = at + len(block), []

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs, path, name = _task_file(folder, "index", 0)
                    out = fs.open_output_stream(path)
                lines.append(line)
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is not None:
            flush()
            sparse = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(sparse + struct.pack(TRAILER, at, len(sparse), MAGIC))
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([directory[0][0]]), pa.array([directory[0][1]], pa.int64())], names=["file", "surt", "page"]
            )

    return cut(placed.mapInArrow(write, "file string, surt string, page long"))


class IndexFile:
    """One open index file: bisects its directory, then reads one block."""

    def __init__(self, name: str) -> None:
        fs, path = FileSystem.from_uri(name)
        self.source = fs.open_input_file(path)
        size = self.source.size()
        tail = struct.calcsize(TRAILER)
        at, length, magic = struct.unpack(TRAILER, self.source.read_at(tail, size - tail))
        if magic != MAGIC:
            raise ValueError(f"{name} is no capture index")
        self.directory = json.loads(zlib.decompress(self.source.read_at(length, at)))
        self.firsts = [(x[0], x[1]) for x in self.directory]
        self.open_block, self.lines = -1, []

    def block(self, number: int) -> list[list]:
        if number != self.open_block:
            at, length = self.directory[number][2:]
            self.lines = [json.loads(x) for x in zlib.decompress(self.source.read_at(length, at)).decode().split("\n")]
            self.open_block = number
        return self.lines

    def find(self, key: str, page: int) -> list[list]:
        """All captures of (key, page): surt, page, file, offset, length."""
        number, out = bisect_right(self.firsts, (key, page)) - 1, []
        while number >= 0:
            lines = self.block(number)
            out = [x for x in lines if x[0] == key and x[1] == page] + out
            if (lines[0][0], lines[0][1]) != (key, page):  # else the captures may begin in the block before
                break
            number -= 1
        return out

    def close(self) -> None:
        self.source.close()


def lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Captures of `wanted` (url, page_id): surt, page, file, offset, length; what the index lacks is left out.

    The first level has one row per index file and is held by every task.
    Equal captures all come back; a capture asked for twice comes back once.
    """
    spark = wanted.sparkSession
    files = sorted((r.surt, r.page, r.file) for r in index.collect())  # one row per index file
    firsts, names = [x[:2] for x in files], [x[2] for x in files]
    keyed = wanted.select(F.col("url").cast("string").alias("url"), F.coalesce(F.col("page_id").cast("long"), F.lit(NO_PAGE)).alias("page"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, pages = [surt(u) for u in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            part = [bisect_right(firsts, k) - 1 for k in zip(keys, pages)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(pages, pa.int64()), pa.array(part, pa.int32())], names=["surt", "page", "part"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, number = None, -1
        for batch in batches:
            out = []
            for key, page, part in zip(*(c.to_pylist() for c in batch.columns)):
                if part != number:
                    if opened is not None:
                        opened.close()
                    opened, number = IndexFile(names[part]), part
                out += opened.find(key, page)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["surt", "page", "file", "offset", "length"])
        if opened is not None:
            opened.close()

    routed = keyed.mapInArrow(route, "surt string, page long, part int").filter("part >= 0").distinct()
    return routed.repartitionByRange(width(spark), "part", "surt", "page").sortWithinPartitions("part", "surt", "page").mapInArrow(find, CAPTURE)


def read_records(captures: DataFrame) -> DataFrame:
    """page_id, url, payload (binary, empty for revisits), payload_bytes, payload_digest, record_type, refers_to of each capture.

    One range read per capture; payload_bytes and payload_digest are those of
    the full payload, and a response whose payload doesn't match them raises.
    """
    spark = captures.sparkSession
    placed = captures.select("file", "offset", "length").repartitionByRange(width(spark), "file", "offset").sortWithinPartitions("file", "offset")
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, name = None, ""
        for batch in batches:
            rows, held = [], 0
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if file != name:
                    if source is not None:
                        source.close()
                    fs, path = FileSystem.from_uri(file)
                    source, name = fs.open_input_file(path), file
                top, http, payload = parse_record(source.read_at(length, offset))
                kind, digest, size = top["warc-type"], top["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
                if kind == "response" and (base32_sha1(payload) != digest or len(payload) != size):
                    raise ValueError(f"{file} at {offset}: payload and digest differ")
                rows.append((page_of(top["warc-record-id"]), top.get("warc-target-uri"), payload, size, digest, kind, page_of(top.get("warc-refers-to"))))
                held += len(payload)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in rows], schema=arrow)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in rows], schema=arrow)
        if source is not None:
            source.close()

    return placed.mapInArrow(read, schema)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Archives all pages, indexes the captures, looks every page up in the index and reads its record."""
    captures = write_archives(pages)
    index = write_index(captures)
    return read_records(lookup(index, pages))
