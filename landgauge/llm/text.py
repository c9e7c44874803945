"""Whole texts as flat numpy arrays: code points, words and word n-gram hashes.

Everything works on a batch of texts laid end to end, so the cost is a few
vector operations per character and no Python loop runs over words. A word is
a maximal run of letters and digits, lower-cased code point by code point, so
offsets into the original text stay valid.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
# texts are cut into batches of about this many code points before they are laid end to end
FLAT_CHARS = 400_000


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(lower-case code point, is letter or digit) of every code point."""
    lower = np.arange(0x110000, dtype=np.uint32)
    word = np.zeros(0x110000, dtype=bool)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            word[i] = True
            low = c.lower()
            if len(low) == 1:
                lower[i] = ord(low)
    return lower, word


_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64 for i up to n."""
    if len(_POWERS[0]) <= n:
        size = 1 << int(n).bit_length()
        for k, base in enumerate((BASE, U64(pow(int(BASE), -1, 1 << 64)))):
            steps = np.full(size + 1, base, U64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def segment_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for every segment."""
    power, inverse = powers(len(values))
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values.astype(U64, copy=False) * power[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts end to end as code points, and the offset of each text."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


class Words:
    """Words of a batch of texts: start, end (code points in the batch), text and hash of each."""

    def __init__(self, texts: list[str]) -> None:
        lower, word = tables()
        self.points, self.offsets = code_points(texts)
        inside = word[self.points]
        cut = np.zeros(len(inside) + 1, bool)
        cut[self.offsets] = True
        begins, closes = inside.copy(), inside.copy()
        if len(inside):
            begins[1:] &= ~inside[:-1] | cut[1:-1]
            closes[:-1] &= ~inside[1:] | cut[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        self.text = np.searchsorted(self.offsets, self.start, "right") - 1
        self.hash = segment_hash(lower[self.points] + np.uint32(1), self.start, self.end)
        # first word of each text, and one past the last
        self.first = np.searchsorted(self.start, self.offsets)

    def sequence_hash(self) -> np.ndarray:
        """One hash per text over its words in order."""
        return segment_hash(self.hash, self.first[:-1], self.first[1:])


def shingles(words: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside each unit, and the offset of each unit's hashes.

    Unit i holds words[first[i]:first[i + 1]]. A unit of fewer than n words has
    one shingle, all of its words; a unit without words has none.
    """
    sizes = np.diff(first)
    many = np.where(sizes == 0, 0, np.maximum(sizes - n + 1, 1))
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(many, out=offsets[1:])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - first[:-1], many)
    stop = np.repeat(first[1:], many)
    padded = np.concatenate([words, np.zeros(n, U64)])
    power, _ = powers(n)
    out = np.zeros(len(at), U64)
    for k in range(n):
        out += np.where(at + k < stop, padded[at + k] * power[k], U64(0))
    return mix(out), offsets


def in_batches(texts: pa.Array | pa.ChunkedArray, chars: int = FLAT_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """(from, to, texts) slices of a column of about `chars` code points each; null reads as empty."""
    values = [t or "" for t in texts.to_pylist()]
    begin, size = 0, 0
    for i, t in enumerate(values):
        size += len(t)
        if size >= chars:
            yield begin, i + 1, values[begin : i + 1]
            begin, size = i + 1, 0
    if begin < len(values):
        yield begin, len(values), values[begin:]


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
