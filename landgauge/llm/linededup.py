"""Lines that stand in many documents, counted in minimal perfect hash tables.

The key of a line is the line without spaces at its ends, in lower case (ASCII
only). Keys go by their 128-bit hash, dealt over shards. Each shard numbers its
distinct hashes by a minimal perfect hash (a chain of bit arrays: a hash takes
the first level where no other one meets it, its number is the count of bits
before it), which indexes two compact arrays: a fingerprint, which tells hashes
that the shard does not hold, and the number of documents, which stops growing
once it decides nothing any more.

Documents meet the shards in packets: a task folds the lines of many documents
into one packet per shard, which has every hash once, so a line that stands
everywhere is one entry of each packet and no task sees more of it. A shard reads
its arrays once and lets the packets pass by. No line is a row of any join; what
comes back to the documents is one short list per text that loses lines.

Every row counts as a document, also if rows are equal; null text is one empty
line; lines with an empty key always stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgauge.llm.scratch import cut
from landgauge.llm.text import U64, mix

MIN_DOCUMENTS = 10
# lines of a shard, and distinct keys of a packet buffer; both bound what a task holds
SHARD_LINES, BUFFER_KEYS = 500_000, 200_000
SPACES = " \t\n\x0b\x0c\r"
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
HASH = np.dtype([("hi", "<u8"), ("lo", "<u8")])

PACKET = "shard int, hashes binary, documents binary, texts binary, ends binary, members binary"
TABLE = "shard int, keys long, sizes array<long>, bits binary, ranks binary, fingerprints binary, counts binary"


def line_key(line: str) -> str:
    return line.strip(SPACES).translate(UPPER)


def key_hash(key: str) -> bytes:
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass"))


class PerfectHash:
    """Numbers m distinct 128-bit hashes 0 .. m-1 without keeping them; other hashes get any number or -1."""

    LOAD = 2.0

    def __init__(self, sizes: list[int], bits: np.ndarray, ranks: np.ndarray) -> None:
        self.sizes, self.bits, self.ranks = sizes, bits, ranks

    @staticmethod
    def place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(hashes["lo"] + U64((level * 0x9E3779B97F4A7C15) % (1 << 64))) ^ hashes["hi"]) % U64(size)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], hashes
        while len(left):
            # whole 64-bit words per level
            size = -(-max(64, int(cls.LOAD * len(left))) // 64) * 64
            place = cls.place(left, len(sizes), size)
            alone = np.bincount(place.astype(np.int64), minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[place]]
        bits = np.concatenate(levels).view("<u8") if levels else np.zeros(0, "<u8")
        return cls(sizes, bits, np.r_[0, np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    def number(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        left, begin = np.arange(len(hashes)), 0
        for level, size in enumerate(self.sizes):
            place = self.place(hashes[left], level, size)
            word, bit = begin + (place >> U64(6)).astype(np.int64), place & U64(63)
            set_ = (self.bits[word] >> bit) & U64(1) == 1
            before = self.bits[word] & ((U64(1) << bit) - U64(1))
            out[left[set_]] = (self.ranks[word] + np.bitwise_count(before))[set_]
            left, begin = left[~set_], begin + size // 64
        return out


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    return (hashes["hi"] >> U64(32)).astype(np.uint32)


def merge(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and their added counts."""
    distinct, which = np.unique(hashes, return_inverse=True)
    return distinct, np.bincount(which, counts, len(distinct)).astype(np.int64)


def packets(docs: DataFrame, shards: int) -> DataFrame:
    """PACKET rows of `docs` (text, digest binary): per shard, hashes with their documents and the texts that hold them."""

    def flush(keys: dict[str, int], entries: list[list[int]], texts: list[bytes], documents: list[int]) -> Iterator[pa.RecordBatch]:
        hashes = np.frombuffer(b"".join(map(key_hash, keys)), HASH)
        of_text = np.repeat(np.arange(len(texts)), [len(e) for e in entries])
        of_key = np.fromiter((k for e in entries for k in e), np.int64, len(of_text))
        shard = (hashes["lo"] % U64(shards)).astype(np.int64)
        digest = np.frombuffer(b"".join(texts), "V16")
        weight = np.array(documents)
        order = np.lexsort((of_text, hashes[of_key]["lo"], hashes[of_key]["hi"], shard[of_key]))
        of_text, of_key = of_text[order], of_key[order]
        cuts = np.flatnonzero(np.diff(shard[of_key])) + 1
        for part in np.split(np.arange(len(of_key)), cuts) if len(of_key) else ():
            text, key = of_text[part], of_key[part]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            own, member = np.unique(text, return_inverse=True)
            columns = [
                hashes[key[first]].tobytes(),
                np.add.reduceat(weight[text], first).astype("<i8").tobytes(),
                digest[own].tobytes(),
                np.r_[first[1:], len(key)].astype("<i4").tobytes(),
                member.astype("<i4").tobytes(),
            ]
            arrays = [pa.array([int(shard[key[0]])], pa.int32()), *(pa.array([c], pa.binary()) for c in columns)]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in PACKET.split(", ")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[str, int] = {}
        seen: dict[bytes, int] = {}
        entries: list[list[int]] = []
        documents: list[int] = []
        held = 0
        for batch in batches:
            for text, digest in zip(batch.column(0), batch.column(1)):
                name = digest.as_py()
                if name in seen:
                    documents[seen[name]] += 1
                    continue
                own = {line_key(x) for x in text.as_py().split("\n")} - {""}
                seen[name] = len(entries)
                entries.append([keys.setdefault(k, len(keys)) for k in own])
                documents.append(1)
                held += len(own)
                if held >= BUFFER_KEYS:
                    yield from flush(keys, entries, list(seen), documents)
                    keys, seen, entries, documents, held = {}, {}, [], [], 0
        yield from flush(keys, entries, list(seen), documents)

    return docs.select("text", "digest").mapInArrow(rows, PACKET)


def count_tables(dealt: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """One TABLE row per shard: the perfect hash of its distinct hashes, their fingerprints and document counts (up to `least`)."""
    kind = np.min_scalar_type(least)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, group in _by_shard(batches):
            hashes, counts, pending, waiting = np.zeros(0, HASH), np.zeros(0, np.int64), [], 0
            for row in group:
                pending.append((np.frombuffer(row["hashes"], HASH), np.frombuffer(row["documents"], "<i8")))
                waiting += len(pending[-1][0])
                if waiting > max(len(hashes), BUFFER_KEYS):
                    hashes, counts = merge(*map(np.concatenate, zip((hashes, counts), *pending)))
                    pending, waiting = [], 0
            hashes, counts = merge(*map(np.concatenate, zip((hashes, counts), *pending)))
            table = PerfectHash.build(hashes)
            at = table.number(hashes)
            marks, numbers = np.zeros(len(hashes), "<u4"), np.zeros(len(hashes), kind)
            marks[at], numbers[at] = fingerprint(hashes), np.minimum(counts, least)
            columns = [pa.array([shard], pa.int32()), pa.array([len(hashes)], pa.int64()), pa.array([table.sizes], pa.list_(pa.int64()))]
            columns += [pa.array([x.tobytes()], pa.binary()) for x in (table.bits, table.ranks, marks, numbers)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in TABLE.split(", ")])

    slim = dealt.select("shard", "hashes", "documents")
    return slim.repartition("shard").sortWithinPartitions("shard").mapInArrow(rows, TABLE)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """(shard, its rows) of rows that come in the order of shards; one row at a time is taken out of its batch."""
    rows = ({name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)} for batch in batches for i in range(batch.num_rows))
    return groupby(rows, lambda r: r["shard"])


def probe(tables: DataFrame, dealt: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """digest, gone (line hashes end to end): of each packet, the texts with keys that `least` documents hold."""
    kind = np.min_scalar_type(least)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _by_shard(batches):
            head = next(group)  # the table comes before the packets
            table = PerfectHash(head["sizes"], np.frombuffer(head["bits"], "<u8"), np.frombuffer(head["ranks"], "<i8"))
            marks, numbers = np.frombuffer(head["fingerprints"], "<u4"), np.frombuffer(head["counts"], kind)
            for row in group:
                hashes = np.frombuffer(row["hashes"], HASH)
                at = table.number(hashes)
                frequent = np.flatnonzero((at >= 0) & (marks[at] == fingerprint(hashes)) & (numbers[at] >= least))
                if not len(frequent):
                    continue
                ends = np.r_[0, np.frombuffer(row["ends"], "<i4")]
                members, digests = np.frombuffer(row["members"], "<i4"), np.frombuffer(row["texts"], "V16")
                size = ends[frequent + 1] - ends[frequent]
                entry = np.arange(size.sum()) - np.repeat(np.r_[0, np.cumsum(size)[:-1]] - ends[frequent], size)
                text, key = members[entry], np.repeat(frequent, size)
                order = np.lexsort((key, text))
                text, key = text[order], key[order]
                first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
                gone = [hashes[part].tobytes() for part in np.split(key, first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([d.tobytes() for d in digests[text[first]]], pa.binary()), pa.array(gone, pa.binary())], ["digest", "gone"])

    both = tables.unionByName(dealt, allowMissingColumns=True)
    return both.repartition("shard").sortWithinPartitions("shard", F.col("keys").isNull()).mapInArrow(rows, "digest binary, gone binary")


def drop_common_lines(docs: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """doc_id, text without the lines whose key `least` documents hold, n_lines (before), n_dropped; a row per row of `docs`."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("digest", F.unhex(F.md5("text")))
    lines = texts.agg(F.sum(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)).head()[0] or 0
    dealt = cut(packets(texts, -(-lines // SHARD_LINES) or 1))
    gone = probe(cut(count_tables(dealt, least)), dealt, least).groupBy("digest").agg(F.collect_set("gone").alias("gone"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, numbers, dropped = [], [], []
            for text, common in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if common is None:
                    kept.append(text)
                    numbers.append(text.count("\n") + 1)
                    dropped.append(0)
                    continue
                common = {part[i : i + 16] for part in common for i in range(0, len(part), 16)}
                own = text.split("\n")
                stay = [x for x in own if not (k := line_key(x)) or key_hash(k) not in common]
                kept.append("\n".join(stay))
                numbers.append(len(own))
                dropped.append(len(own) - len(stay))
            columns = [batch.column(0), pa.array(kept, pa.string()), pa.array(numbers, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_lines", "n_dropped"])

    met = texts.join(gone, "digest", "left").select("doc_id", "text", "gone")
    return met.mapInArrow(rows, "doc_id long, text string, n_lines long, n_dropped long")


def line_digests(docs: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of `docs`."""
    kept = drop_common_lines(docs, least)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
