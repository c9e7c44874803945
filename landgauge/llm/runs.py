"""Periodic runs of words, found by recursive frequency splitting and a lag scan.

A run is a stretch of words with smallest period q (words q apart are the same)
of at least max(MIN_LENGTH, MIN_PERIODS * q) words that no neighbouring word
extends keeping period q. Every word of a run stands in it MIN_PERIODS times at
least, so a word that is rarer than that within a segment belongs to no run of
the segment and splits it. Splitting goes on in the segments that changed until
none does; segments of fewer than MIN_LENGTH words go. The segments that are
left are scanned lag by lag.

A lag q of a run holds for 2q words in a row, so it holds at some multiple of q
and the q words behind it. Only the multiples are tested first, which takes
m log m tests for a segment of m words in place of m * m / 3; what passes is
compared word by word and extended to both sides. A lag whose test falls inside
a run of a period that divides it is that run again and is left out.

Each document is worked on by itself, so nothing is shuffled. Null text counts as
no words; the document of a null id is not damaged; repeated rows are documents
of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgauge.llm.text import in_batches

MIN_LENGTH, MIN_PERIODS = 24, 3
WORD = re.compile("[^\x20\x09-\x0d]+")
Run = tuple[int, int, int]  # start, length, period

RUN_COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long"
SCHEMA = f"doc_id long, {RUN_COLUMNS}, runs_sha256 string, collapsed_sha256 string"


def split_segments(word: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of word[start:end] that can hold runs; `word` are dense non-negative ids.

    All segments of a round are counted together, and only those that were split
    go to the next round.
    """
    done: list[tuple[int, int]] = []
    kinds = int(word.max()) + 1 if len(word) else 1
    while True:
        long = ends - starts >= MIN_LENGTH
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return sorted(done)
        size = ends - starts
        begin = np.r_[0, np.cumsum(size)]
        segment = np.repeat(np.arange(len(starts)), size)
        at = np.arange(begin[-1]) - np.repeat(begin[:-1] - starts, size)
        _, kind, count = np.unique(segment * kinds + word[at], return_inverse=True, return_counts=True)
        rare = count[kind] < MIN_PERIODS
        split = np.add.reduceat(rare, begin[:-1]) > 0
        done += zip(starts[~split].tolist(), ends[~split].tolist())
        # a stretch begins at a common word behind a rare one or a border, and ends likewise
        common = ~rare & split[segment]
        border = np.zeros(len(at) + 1, bool)
        border[begin] = True
        first, last = common.copy(), common.copy()
        first[1:] &= ~common[:-1] | border[1:-1]
        last[:-1] &= ~common[1:] | border[1:-1]
        starts, ends = at[first], at[last] + 1


def _matches(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values of a and b are the same, looked up in growing steps."""
    done, step, n = 0, 32, min(len(a), len(b))
    while done < n:
        differ = a[done : done + step] != b[done : done + step]
        if differ.any():
            return done + int(differ.argmax())
        done += len(differ)
        step *= 2
    return n


def lag_tests(word: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(lag, places) for every lag with places, multiples of the lag, where it may hold for lag + 1 words; by lag.

    Lags from some power of two to the next are tested together, on at most 2 * len(word) places.
    """
    n, low = len(word), 1
    while low <= n // MIN_PERIODS:
        lags = np.arange(low, min(2 * low, n // MIN_PERIODS + 1))
        place = np.arange(n // low)[:, None] * lags
        lag = np.broadcast_to(lags, place.shape)
        inside = place + 2 * lag < n
        place, lag = place[inside], lag[inside]
        # three words a lag apart, then some more within the same period
        for part in (0, 8, 4, 2, 6, 1, 3, 5, 7):
            at = place + part * lag // 8
            same = word[at] == word[at + lag]
            place, lag = place[same], lag[same]
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        for own in np.split(np.arange(len(lag)), np.flatnonzero(np.diff(lag)) + 1) if len(lag) else ():
            yield int(lag[own[0]]), place[own]
        low *= 2


def scan(word: np.ndarray) -> list[Run]:
    """The runs of a whole segment, by period and start."""
    found: dict[int, list[tuple[int, int]]] = {}
    n = len(word)
    for q, place in lag_tests(word):
        covers = [span for d, spans in found.items() if q % d == 0 for span in spans]
        for a, b in covers:
            place = place[(place < a) | (place + 2 * q >= b)]
        end = -1
        for p in place.tolist():
            if p < end:
                continue
            right = _matches(word[p : n - q], word[p + q :])
            if right <= q:
                continue
            left = _matches(word[:p][::-1], word[q : p + q][::-1])
            if right + left + q >= max(MIN_LENGTH, MIN_PERIODS * q):
                found.setdefault(q, []).append((p - left, p + right + q))
            end = p + right
    return [(a, b - a, q) for q, spans in found.items() for a, b in spans]


def find_runs(word: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[Run]:
    """All runs within word[start:end], by start and period."""
    return sorted(((a + s, length, q) for a, b in split_segments(word, starts, ends) for s, length, q in scan(word[a:b])), key=lambda r: (r[0], r[2]))


def best_run(runs: list[Run]) -> Run | None:
    """The run of most periods, compared exactly; the first start, then the smallest period, on ties."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def dropped_words(n: int, runs: list[Run]) -> np.ndarray:
    """True for the words that stand behind the first period of some run."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) > 0


def repeat_tail(words: list[str], doc_id: int | None) -> list[str]:
    """The words with a periodic tail, in one document of ten (by the id's CRC-32)."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // len(unit) + 1))[: n - a]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def runs_of(lists: list[list[str]]) -> list[list[Run]]:
    """The runs of each list of words."""
    flat = pa.array([w for words in lists for w in words], pa.large_string()).dictionary_encode().indices.to_numpy().astype(np.int64)
    edge = np.r_[0, np.cumsum([len(words) for words in lists])].astype(np.int64)
    runs = find_runs(flat, edge[:-1], edge[1:])
    owner = np.searchsorted(edge, [r[0] for r in runs], "right") - 1
    out: list[list[Run]] = [[] for _ in lists]
    for doc, (start, length, q) in zip(owner.tolist(), runs):
        out[doc].append((start - int(edge[doc]), length, q))
    return out


def periodic_runs(docs: DataFrame, damaged: bool = False) -> DataFrame:
    """doc_id, runs (start, length, period by start and period), collapsed: the text's words without the repeated periods.

    With `damaged`, documents are first given the tails of `repeat_tail`. Other columns of `docs` are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, runs in _found(batches, damaged):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs], _RUNS),
                    pa.array([" ".join(_kept(w, r)) for w, r in zip(words, runs)], pa.string()),
                ],
                ["doc_id", "runs", "collapsed"],
            )

    schema = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return _slim(docs).mapInArrow(rows, schema)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def run_digests(docs: DataFrame) -> DataFrame:
    """The runs of the damaged texts as SCHEMA: their number, the run of most periods (nulls if none) and digests."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, runs in _found(batches, True):
            best = [best_run(own) for own in runs]
            columns = [pa.array(ids, pa.int64()), pa.array([len(own) for own in runs], pa.int64())]
            columns += [pa.array([b and b[k] for b in best], pa.int64()) for k in range(3)]
            columns.append(pa.array([b and 1000 * b[1] // b[2] for b in best], pa.int64()))
            columns.append(pa.array([_sha("".join(f"{s},{n},{q}\n" for s, n, q in own)) for own in runs], pa.string()))
            columns.append(pa.array([_sha(" ".join(_kept(w, r))) for w, r in zip(words, runs)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return _slim(docs).mapInArrow(rows, SCHEMA)


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _kept(words: list[str], runs: list[Run]) -> list[str]:
    if not runs:
        return words
    gone = dropped_words(len(words), runs)
    return [words[i] for i in np.flatnonzero(~gone).tolist()]


def _found(batches: Iterator[pa.RecordBatch], damaged: bool) -> Iterator[tuple[list[int | None], list[list[str]], list[list[Run]]]]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for a, b, texts in in_batches(batch.column(1)):
            words = [WORD.findall(t) for t in texts]
            if damaged:
                words = [repeat_tail(w, i) for w, i in zip(words, ids[a:b])]
            yield ids[a:b], words, runs_of(words)
