"""Document fingerprints by consistent weighted sampling.

A text is a set of weighted terms (adjacent word pairs with their counts). For
each of SAMPLES hash functions a term of weight w gets, from two gamma(2, 1)
variates r and c and a uniform b, the level t = floor(ln w / r + b) and the value
ln a = ln c - r (t - b) - r; the term of the smallest value is the sample. Two
texts agree on (term, level) with a probability equal to the generalised
Jaccard similarity, sum of min weights over sum of max weights.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landgauge.llm.scratch import cut, width
from landgauge.llm.text import U64, Words, in_batches, mix, shingles

SAMPLES, TERM_BITS, SEED = 64, 62, 20240501
CHUNK = 2048  # terms drawn for at a time
NO_ID = -(1 << 63)


@cache
def seeds() -> tuple[np.ndarray, np.ndarray]:
    """Two seeds per sample."""
    both = mix(np.arange(1, 2 * SAMPLES + 1, dtype=U64) * U64(0x632BE59BD9B4E019) + U64(SEED))
    return both[:SAMPLES], both[SAMPLES:]


def variates(term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, b, ln c) per term and sample, drawn from hashes of the term itself."""
    spread = (term.astype(U64) * U64(0x9E3779B97F4A7C15))[:, None]

    def hashed(seed: np.ndarray) -> np.ndarray:
        x = spread ^ seed
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(32)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(29)
        return x

    def uniform(hashes: np.ndarray, shift: int, bits: int) -> np.ndarray:
        """In steps that a float holds exactly, neither 0 nor 1."""
        out = ((hashes >> U64(shift)).astype(np.uint32) & np.uint32((1 << bits) - 1)).astype(np.float32)
        out += np.float32(0.5)
        out *= np.float32(2.0**-bits)
        return out

    one, two = (hashed(seed) for seed in seeds())
    r = uniform(one, 43, 21)
    r *= uniform(one, 22, 21)
    c = uniform(two, 41, 23)
    c *= uniform(two, 18, 23)
    for x in (r, c):
        np.negative(np.log(x, out=x), out=x)
    return r, uniform(one, 1, 21), np.log(c, out=c)


def terms(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, weight, offsets) of the distinct terms of each unit: word pairs, or the word of a text that has one only."""
    pairs, offsets = shingles(words, first, 2)
    term = (pairs >> U64(64 - TERM_BITS)).astype(np.int64)
    unit = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((term, unit))
    term, unit = term[order], unit[order]
    fresh = np.ones(len(term), bool)
    fresh[1:] = (term[1:] != term[:-1]) | (unit[1:] != unit[:-1])
    at = np.flatnonzero(fresh)
    return term[at], np.diff(np.r_[at, len(term)]), np.searchsorted(unit[at], np.arange(len(offsets)))


def sample(term: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """uint32 [SAMPLES]: hash of the sampled (term, level); zeros where there is no term."""
    if not len(term):
        return np.zeros(SAMPLES, np.uint32)
    least, across = np.full(SAMPLES, np.inf), np.arange(SAMPLES)
    chosen, levels = np.zeros(SAMPLES, np.int64), np.zeros(SAMPLES, np.int64)
    for begin in range(0, len(term), CHUNK):
        own, w = term[begin : begin + CHUNK], weight[begin : begin + CHUNK]
        r, b, ln_c = variates(own)
        value = ln_c + r * (b - 1)  # ln 1 = 0, so the level of weight 1 is floor(b) = 0
        heavy = np.flatnonzero(w > 1)
        level = np.floor(np.log(w[heavy])[:, None] / r[heavy].astype(np.float64) + b[heavy])
        value[heavy] -= r[heavy] * level
        low = value.argmin(axis=0)
        better = value[low, across] < least
        least = np.where(better, value[low, across], least)
        chosen = np.where(better, own[low], chosen)
        if len(heavy):
            place = np.minimum(np.searchsorted(heavy, low), len(heavy) - 1)
            low_level = np.where(heavy[place] == low, level[place, across], 0).astype(np.int64)
        else:
            low_level = np.zeros(SAMPLES, np.int64)
        levels = np.where(better, low_level, levels)
    return (mix(mix(chosen.astype(U64)) + levels.astype(U64)) >> U64(32)).astype(np.uint32) | np.uint32(1)


def signatures(texts: list[str]) -> np.ndarray:
    """uint32 [texts, SAMPLES]."""
    words = Words(texts)
    term, weight, offsets = terms(words.hash, words.first)
    return np.array([sample(term[a:b], weight[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], np.uint32).reshape(-1, SAMPLES)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of samples that agree, row by row: an estimate of the generalised Jaccard similarity."""
    return (a == b).mean(axis=1)


def as_text(signature: np.ndarray) -> str:
    return signature.astype("<u4").tobytes().hex()


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds `fingerprint` (hex) to every row of `docs`; a column of that name is replaced.

    A null text counts as empty; texts without a word share the fingerprint of zeros.
    """
    kept = [c for c in docs.columns if c != "fingerprint"]
    source = docs.select(*kept, F.col(text_col).cast("string").alias("_text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, texts in in_batches(batch.column(len(kept))):
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([as_text(s) for s in signatures(texts)])], names=[*kept, "fingerprint"])

    return source.mapInArrow(sign, source.drop("_text").schema.add("fingerprint", "string"))


def in_id_order(docs: DataFrame, parts: int) -> DataFrame:
    """part, id, text, guest: rows in ranges of descending id, each range closed by a guest copy of the row that follows it.

    Rows are ordered by descending id, then text; null ids come last. The row
    after the very last is the very first. Every range is one value of part;
    range borders are quantiles of the ids, one per part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = sorted({int(x) for x in rows.approxQuantile("id", [i / parts for i in range(1, parts)], 0.5 / parts)}) if parts > 1 else []
    if not cuts:
        placed = rows.withColumn("part", F.lit(0))
    else:
        borders = F.array(*[F.lit(c) for c in cuts])
        # how many borders lie above the id: 0 holds the largest ids
        placed = rows.withColumn("part", F.size(F.filter(borders, lambda b: b > F.col("id"))))
    heads = cut(placed.groupBy("part").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n")))
    found = sorted((r["part"], r["id"]) for r in heads.collect())  # one row per range
    if not found:
        return placed.select("part", "id", "text", F.lit(False).alias("guest"))
    before = {found[i][0]: found[i - 1][0] for i in range(len(found))}
    tops = spark.createDataFrame([(p, i, before[p]) for p, i in found], "part int, id long, to int")
    guests = (
        rows.join(F.broadcast(tops.select("id", "to")), "id").groupBy("to").agg(F.min("text").alias("text"), F.max("id").alias("id"))
        .select(F.col("to").alias("part"), "id", "text", F.lit(True).alias("guest"))
    )
    return placed.select("part", "id", "text", F.lit(False).alias("guest")).unionByName(guests)


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as many first code points of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, its edited text and the next document's, with their likeness.

    The next document is that of the next smaller doc_id; after the last comes
    the first. Rows of equal doc_id are ordered by text, null ids come last; a
    sole document is its own next. Null texts count as empty, and a text
    without a word has likeness 1 to another such text and 0 to all others.
    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.
    """
    spark = docs.sparkSession
    parts = width(spark)
    placed = in_id_order(docs, parts).repartitionByRange(parts, "part")
    ordered = placed.sortWithinPartitions(F.asc("part"), F.asc("guest"), F.desc("id"), F.asc("text")).select("part", "guest", "id", "text")

    def rows(held: list[tuple[int, bool, int, str]]) -> pa.RecordBatch:
        """All rows but the last, each with its next."""
        texts = [h[3] for h in held]
        own = signatures(texts)
        mask = [i for i in range(len(held) - 1) if not held[i][1]]
        changed = [edited(texts[i], texts[i + 1]) for i in mask]
        other = signatures(changed)
        index = np.array(mask, np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([None if held[i][2] == NO_ID else held[i][2] for i in mask], pa.int64()),
                pa.array([len(texts[i]) for i in mask], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
                pa.array([as_text(own[i]) for i in mask], pa.string()),
                pa.array([as_text(s) for s in other], pa.string()),
                pa.array(likeness(own[index], other), pa.float64()),
                pa.array(likeness(own[index], own[index + 1]), pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bool, int, str]] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += len(row[3])
                if size > 400_000 and len(held) > 1:
                    yield rows(held)
                    held = held[-1:]
                    size = len(held[0][3])
        if len(held) > 1:
            yield rows(held)

    return ordered.mapInArrow(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
