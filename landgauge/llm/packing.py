"""Best-fit packing of tokenised documents into sequences, planned over the length histogram.

Method: documents become token ids and are cut into pieces; the histogram of
piece lengths (one row per possible length at most) goes to the driver, which
plans best-fit decreasing over counts: whole ranges of equal pieces are placed
in whole ranges of equally filled sequences. A piece then takes the planned
slot of its rank among the pieces of its length. The plan's size is bounded by
the sequence length, whatever the number of documents.
"""

from __future__ import annotations

import bisect
import os
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landgauge.llm.scratch import cut
from landgauge.llm.text import in_batches, code_points, list_array, segment_hash

SEQUENCE, END_ID = 4096, 1
VOCABULARY = "word_bpe_49k.json"
RANK_ROWS = 20_000  # rows of one length that one ranking group holds on average

# ---- tokens ----------------------------------------------------------------

SPACE, LETTER, NUMBER, OTHER, UNSURE = range(5)
PLAIN = 0x300  # code points below this need no normalisation


@cache
def plain_tables() -> tuple[np.ndarray, np.ndarray]:
    """(kind, lower case) of the code points below PLAIN; UNSURE ones are left to the tokenizer."""
    kind, lower = np.full(PLAIN + 1, OTHER, np.uint8), np.arange(PLAIN + 1, dtype=np.uint32)
    for i in range(PLAIN):
        c, major = chr(i), unicodedata.category(chr(i))[0]
        if c in "\t\n\r \xa0":
            kind[i] = SPACE
        elif major == "C" or major == "Z" or len(c.lower()) != 1:
            kind[i] = UNSURE
        else:
            kind[i] = {"L": LETTER, "N": NUMBER}.get(major, OTHER)
            lower[i] = ord(c.lower())
    kind[PLAIN] = UNSURE
    return kind, lower


class Encoder:
    """Token ids of texts, equal to those of the tokenizer for every text.

    The tokenizer treats each word, digit or run of signs by itself, so a batch
    asks it once for each different one; texts with code points that would need
    normalising, or with the marks of special tokens, go to it whole.
    """

    MOST = 1_500_000  # different words remembered

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.reset()

    def reset(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted hashes, and which word each is
        self.begin, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """`hashes` are sorted and new."""
        found = self.whole(words)
        at = np.searchsorted(self.known, hashes)
        self.place = np.insert(self.place, at, np.arange(len(self.known), len(self.known) + len(words), dtype=np.int32))
        self.known = np.insert(self.known, at, hashes)
        self.begin = np.r_[self.begin, self.begin[-1] + np.cumsum([len(x) for x in found])]
        self.ids = np.concatenate([self.ids, *found])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        kind_of, lower_of = plain_tables()
        points, offsets = code_points(texts)
        kind = kind_of[np.minimum(points, PLAIN)]
        unsure = np.concatenate([[0], np.cumsum(kind == UNSURE)])
        hard = [i for i, t in enumerate(texts) if unsure[offsets[i + 1]] > unsure[offsets[i]] or "<|" in t]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for i, ids in zip(hard, self.whole([texts[i] for i in hard])):
            out[i] = ids
        if len(hard) == len(texts):
            return out
        if hard:
            easy = sorted(set(range(len(texts))) - set(hard))
            for i, ids in zip(easy, self.encode([texts[i] for i in easy])):
                out[i] = ids
            return out
        lower = lower_of[points]
        begins = kind != SPACE
        if len(kind):
            begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        edge = offsets[:-1][np.diff(offsets) > 0]
        begins[edge] = kind[edge] != SPACE
        self._contractions(begins, kind, lower, offsets)
        starts = np.flatnonzero(begins)
        stops = np.r_[starts[1:], len(kind)]  # white space at the end of a piece is cut off
        space = np.flatnonzero(kind == SPACE)
        if len(space):
            at = np.searchsorted(space, starts)
            stops = np.minimum(stops, np.where(at < len(space), space[np.minimum(at, len(space) - 1)], len(kind)))
        stops = np.minimum(stops, offsets[np.searchsorted(offsets, starts, "right")])
        hashes = segment_hash(lower, starts, stops)
        unique, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.MOST:
            self.reset()
        at = np.searchsorted(self.known, unique)
        fresh = np.ones(len(unique), bool)
        inside = at < len(self.known)
        fresh[inside] = self.known[at[inside]] != unique[inside]
        if fresh.any():
            text = lower.tobytes().decode("utf-32-le")
            self.learn(unique[fresh], [text[starts[i] : stops[i]] for i in first[fresh]])
        index = self.place[np.searchsorted(self.known, unique)].astype(np.int64)[place]
        sizes = self.begin[index + 1] - self.begin[index]
        ends = np.r_[0, np.cumsum(sizes)]
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.begin[index] - ends[:-1], sizes)]
        cuts = ends[np.searchsorted(starts, offsets)]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    @staticmethod
    def _contractions(begins: np.ndarray, kind: np.ndarray, lower: np.ndarray, offsets: np.ndarray) -> None:
        """An apostrophe that begins a run of signs takes the letters of a contraction to itself."""
        text_end = offsets[1:]
        for i in np.flatnonzero(begins & (lower == ord("'"))).tolist():
            end = int(text_end[np.searchsorted(text_end, i, "right")])
            tail = lower[i + 1 : min(i + 3, end)].tobytes().decode("utf-32-le")
            n = 1 if tail[:1] in ("s", "t", "m", "d") and tail else 2 if tail in ("re", "ve", "ll") else 0
            if n:
                begins[i + 1] = False
                if i + 1 + n < end:
                    begins[i + 1 + n] = kind[i + 1 + n] != SPACE


@cache
def encoder(vocabulary: str) -> Encoder:
    import public_tokenizers

    return Encoder(vocabulary if os.sep in vocabulary else public_tokenizers.path(vocabulary))


def token_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 [, ids]: each document's ids and the end id, cut into pieces of `sequence`."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            docs_ids = batch.column(0).to_pylist()
            for begin, end, texts in in_batches(batch.column(1)):
                rows: list[tuple] = []
                for doc, ids in zip(docs_ids[begin:end], encode(texts)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for number, at in enumerate(range(0, len(ids), sequence)):
                        part = ids[at : at + sequence]
                        rows.append((doc, number, at, len(part), zlib.crc32(part.tobytes()), part))
                *columns, parts = zip(*rows)
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(list_array(np.concatenate(parts).astype(np.int32), np.r_[0, np.cumsum(columns[3])]))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(split, schema)


# ---- plan ------------------------------------------------------------------


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, pieces, first sequence, offset) ranges.

    The pieces of a length with ranks first .. first + pieces - 1 go to
    sequences first sequence, first sequence + 1, ..., at that offset.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> ranges (first sequence, sequences)
    free: list[int] = []  # the keys of `room` that have ranges, in order
    sequences = 0

    def leave(space: int, first: int, count: int) -> None:
        if space and count:
            if not room[space]:
                bisect.insort(free, space)
            room[space].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(free, length)
            if at < len(free):
                space = free[at]
                first, count = room[space].pop()
                if not room[space]:
                    free.pop(at)
                used = min(count, left)
                slots.append((length, rank, used, first, sequence - space))
                leave(space, first + used, count - used)
                leave(space - length, first, used)
                left, rank = left - used, rank + used
            else:
                each = min(sequence // length, left)  # pieces that fill a fresh sequence
                count = left // each
                for k in range(each):
                    slots.append((length, rank, count, sequences, k * length))
                    rank += count
                leave(sequence - each * length, sequences, count)
                left, sequences = left - each * count, sequences + count
    return slots


def take_slots(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to written pieces (doc_id, piece, start, length, ...)."""
    counts = pieces.groupBy("length").count().collect()  # a row per possible length at most
    slots = sorted(plan({r["length"]: r["count"] for r in counts}, sequence))
    total = sum(r["count"] for r in counts)
    # slots sorted by (length, rank): a piece's slot is the last that begins at or before its rank
    table = np.array(slots, np.int64).reshape(-1, 5)
    base = np.int64(max(1, total))  # ranks stay below this, so length and rank make one key
    starts = table[:, 0] * base + table[:, 1]

    groups = max(32, -(-total // RANK_ROWS))
    marked = pieces.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    sizes = cut(marked.groupBy("length", "_g").agg(F.count(F.lit(1)).alias("_n")))
    before = sizes.select(
        "length", "_g", (F.sum("_n").over(Window.partitionBy("length").orderBy("_g")) - F.col("_n")).alias("_before")
    )
    own = F.row_number().over(Window.partitionBy("length", "_g").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = marked.withColumn("_own", own).join(before.hint("merge"), ["length", "_g"]).withColumn("_rank", F.col("_before") + F.col("_own") - 1)
    names = pieces.columns
    source = ranked.select(*names, "_rank")
    where = names.index("length")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(where).to_numpy(), batch.column(len(names)).to_numpy()
            slot = table[np.searchsorted(starts, length * base + rank, "right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(slot[:, 3] + rank - slot[:, 1]), pa.array(slot[:, 4])], names=[*names, "sequence_id", "offset"]
            )

    return source.mapInArrow(take, pieces.schema.add("sequence_id", "long").add("offset", "long"))


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Packs all rows of `docs` (doc_id, text) into sequences of at most `sequence` tokens.

    One row per piece: doc_id, piece (from 0), start (ids of the document
    before it), length, ids_crc32 (of the little-endian unsigned 32-bit ids),
    sequence_id, offset [, ids]. A null or empty text is the end id alone; only
    documents longer than a sequence are cut; pieces of a sequence follow each
    other without a gap. A repeated row is packed as often as it stands there.
    Further columns of `docs` are left out.
    """
    return take_slots(cut(token_pieces(docs, vocabulary, sequence, end_id, with_ids)), sequence)
