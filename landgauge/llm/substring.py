"""Removal of text that repeats across documents, by MinHash banding of paragraphs.

Paragraphs are of two grains. A natural paragraph is a line of at least
MIN_WORDS words. Passages are also quoted inside longer lines, where their
neighbours hide them from any comparison of lines, or wrapped over short ones;
so whole texts are cut a second time, without regard to line breaks, at places
that depend on the nearby words alone (a word pair whose hash is the smallest
within REACH words), and a quoted passage is cut alike wherever it stands.

Lines are banded over MinHash signatures of their five-word shingles, colliding
lines are tied together, all pairs within a candidate group are verified by
exact Jaccard in bounded blocks, and the components of verified pairs are the
classes. From each cut a window runs to the next cut that gives it MIN_WORDS
words; windows are banded by the whole sequence of their words, and windows
that touch and repeat one place alike make up a passage.

Of each class the first occurrence (smallest document id, then position) stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landgauge.llm import minhash, ngram_join
from landgauge.llm.components import components
from landgauge.llm.scratch import cut
from landgauge.llm.text import U64, Words, in_batches, list_array, mix, segment_hash, shingles

N, THRESHOLD, MIN_WORDS, REACH = 5, 0.8, 20, 5
RECALL, MOST_HASHES = 0.995, 24
UNITS = "is_line boolean, key long, doc long, at int, n int, bands array<long>"
LAST = U64(0xFFFFFFFFFFFFFFFF)


def line_starts(words: Words) -> np.ndarray:
    """Index of the first word of each line that has words, and one past the last word."""
    breaks = np.cumsum(words.points == 10)[words.start] if len(words.start) else np.zeros(0, np.int64)
    fresh = np.ones(len(breaks), bool)
    fresh[1:] = (breaks[1:] != breaks[:-1]) | (words.text[1:] != words.text[:-1])
    return np.r_[np.flatnonzero(fresh), len(breaks)]


def content_cuts(hashes: np.ndarray, first: np.ndarray, reach: int) -> np.ndarray:
    """bool per word: a piece begins here. Lines (first[i] .. first[i + 1]) are cut apart, and inside
    a line a word pair is a cut if its hash is below those of `reach` pairs before and not above
    those of `reach` pairs after."""
    line = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair = np.full(len(hashes), LAST, U64)
    if len(hashes) > 1:
        pair[:-1] = np.where(line[:-1] == line[1:], mix(hashes[:-1] * U64(3) + hashes[1:]), LAST)
    best = pair != LAST
    for k in range(1, min(reach, len(hashes) - 1) + 1):
        same = line[:-k] == line[k:]
        best[k:] &= ~same | (pair[k:] < pair[:-k])
        best[:-k] &= ~same | (pair[:-k] <= pair[k:])
    best[first[:-1]] = True
    return best


def windows(hashes: np.ndarray, texts: np.ndarray, lines: np.ndarray, least: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, one past the last) of stretches of `least` words and a few more, cut at content-defined places.

    texts and lines hold the index of each first word, and one past the last
    word. Line breaks don't move the cuts. From every cut and every line start a
    stretch runs to the next cut that makes it long enough, and one ends with
    each line. Any `least` words between two cuts that stand in two places thus
    have a stretch in common, whatever else repeats there.
    """
    cuts = np.flatnonzero(content_cuts(hashes, texts, reach))
    starts, stops = np.union1d(cuts, lines[:-1]), np.r_[cuts, len(hashes)]
    starts = starts[starts + least <= texts[np.searchsorted(texts, starts, "right")]]
    until = stops[np.searchsorted(stops, starts + least)]
    ends = lines[1:]
    ends = ends[texts[np.searchsorted(texts, ends) - 1] + least <= ends]
    since = cuts[np.searchsorted(cuts, ends - least, "right") - 1]
    both = np.unique(np.r_[starts, since] * (len(hashes) + 1) + np.r_[until, ends])
    return both // (len(hashes) + 1), both % (len(hashes) + 1)


def units(docs: DataFrame, min_words: int, reach: int, bands: int, rows: int) -> DataFrame:
    """Lines of min_words words and more, with band keys, and the windows of whole texts."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for begin, _, texts in in_batches(batch.column(1)):
                words = Words(texts)
                if not len(words.start):
                    continue
                first = line_starts(words)
                starts, stops = windows(words.hash, np.unique(words.first), first, min_words, reach)
                long = np.flatnonzero(np.diff(first) >= min_words)
                a, b = first[long], first[long + 1]
                # the long lines' words, end to end
                sizes = b - a
                edge = np.r_[0, np.cumsum(sizes)]
                take = np.arange(edge[-1]) + np.repeat(a - edge[:-1], sizes)
                grams, offsets = shingles(words.hash[take], edge, N)
                keys = minhash.band_keys(grams, offsets, bands, rows)
                at = np.arange(len(words.start)) - words.first[words.text]  # word offset in its document
                doc = ids[begin + words.text]
                lines, pieces = len(long), len(starts)
                begins, ends = np.r_[a, starts], np.r_[b, stops]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[np.ones(lines, bool), np.zeros(pieces, bool)]),
                        pa.array(segment_hash(words.hash, begins, ends).view(np.int64)),
                        pa.array(doc[begins]),
                        pa.array(at[begins].astype(np.int32)),
                        pa.array((ends - begins).astype(np.int32)),
                        list_array(keys.ravel(), np.r_[np.arange(lines + 1) * bands, np.full(pieces, lines * bands)]),
                    ],
                    names=["is_line", "key", "doc", "at", "n", "bands"],
                )

    source = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return source.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).mapInArrow(split, UNITS)


def line_sets(texts: DataFrame, n: int) -> DataFrame:
    """Rows text, wanted (lines of it: at, n, grp, b, blocks, node, size) as verify() takes them, one per line.

    A line whose words are not those of `node` goes.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(1).to_pylist()
            for begin, _, texts in in_batches(batch.column(0)):
                words = Words(texts)
                rows, sets = [], []
                for i in range(len(texts)):
                    for line in asked[begin + i]:
                        a = words.first[i] + line["at"]
                        own = words.hash[a : min(a + line["n"], words.first[i + 1])]
                        edge = np.array([0, len(own)])
                        if segment_hash(own, edge[:-1], edge[1:]).view(np.int64)[0] == line["node"]:
                            rows.append([line[k] for k in ("grp", "b", "blocks", "node", "size")])
                            sets.append(np.unique(shingles(own, edge, n)[0]))
                if rows:
                    grp, b, blocks, node, size = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(grp, pa.int64()), pa.array(b, pa.int32()), pa.array(blocks, pa.int32()), pa.array(node, pa.int64()), pa.array(size, pa.int64()),
                            list_array(np.concatenate(sets).view(np.int64), np.r_[0, np.cumsum([len(s) for s in sets])]),
                        ],
                        names=["grp", "b", "blocks", "node", "size", "grams"],
                    )

    return texts.select("text", "wanted").mapInArrow(gather, ngram_join.SET_SCHEMA)


def line_classes(found: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """key, k_doc, k_at, members: the class of each different line that repeats, exactly or nearly."""
    lines = cut(
        found.filter("is_line").groupBy("key").agg(
            F.min(F.struct("doc", "at", "n")).alias("first"), F.count(F.lit(1)).alias("size"), F.first("bands").alias("bands")
        ).select("key", "first.*", "size", "bands")
    )
    candidate = components(minhash.star_edges(lines.select(F.col("key").alias("node"), F.explode(F.array_distinct("bands")).alias("bucket")), cut), cut)
    grouped = candidate.select("node", F.col("root").alias("grp")).unionByName(candidate.select(F.col("root").alias("node"), F.col("root").alias("grp")).distinct())
    members = cut(grouped.join(lines.select(F.col("key").alias("node"), "doc", "at", "n", "size", F.col("n").alias("weight")), "node"))
    wanted = minhash.dealt_blocks(members, cut).groupBy("doc").agg(
        F.collect_list(F.struct("at", "n", "grp", "b", "blocks", "node", "size")).alias("wanted")  # lines of one document
    )
    texts = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")
    )
    judged = cut(ngram_join.verify(line_sets(texts.join(wanted.hint("merge"), "doc"), N), threshold))
    joined = components(judged.select(F.col("node").alias("u"), F.col("root").alias("v")), cut)
    named = cut(lines.select("key", "doc", "at", "size").join(joined.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key")))
    totals = cut(named.groupBy("root").agg(F.min(F.struct("doc", "at")).alias("k"), F.sum("size").alias("members")).filter("members > 1"))
    return cut(named.select("key", "root").join(totals, "root").select("key", F.col("k.doc").alias("k_doc"), F.col("k.at").alias("k_at"), "members"))


def passages(found: DataFrame) -> DataFrame:
    """doc, at, n, k_doc, k_at: runs of windows that repeat, with their first occurrence.

    A window is judged as a whole, so a part of it that stands in an earlier
    document too doesn't hide it. Windows that touch and repeat the same place
    make one run; a window that overlaps its own first occurrence is no repeat.
    """
    pieces = found.filter("not is_line").select("key", "doc", "at", "n")
    repeated = cut(
        pieces.groupBy("key").agg(F.min(F.struct("doc", "at")).alias("k"), F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("key", F.col("k.doc").alias("k_doc"), F.col("k.at").alias("k_at"))
    )
    seen = pieces.join(repeated, "key").drop("key").dropDuplicates(["doc", "at", "n"]).withColumn("_by", F.col("at") - F.col("k_at"))
    apart = seen.filter((F.col("doc") != F.col("k_doc")) | (F.col("_by") == 0) | (F.col("_by") >= F.col("n")))
    order = Window.partitionBy("doc", "k_doc", "_by").orderBy("at", "n")
    reached = F.max(F.col("at") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = apart.withColumn("_new", F.coalesce(F.col("at") > reached, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc", "k_doc", "_by", "_run").agg(
        F.min("at").alias("at"), (F.max(F.col("at") + F.col("n")) - F.min("at")).cast("int").alias("n"), F.min("k_at").alias("k_at")
    ).drop("_by", "_run")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, threshold: float = THRESHOLD, reach: int = REACH) -> DataFrame:
    """One row per repeated stretch: doc_id, grain, first_word, n_words, kept_doc_id, kept_word, removed.

    grain is `paragraph` (a line alike to others, five-word Jaccard `threshold`
    or more) or `passage` (words that stand in several places alike, however
    their lines are broken). first_word counts the words of the document from 0; kept_doc_id and
    kept_word tell the occurrence that stays, for which removed is false.
    Stretches of fewer than `min_words` words are left alone. Rows with a null
    doc_id or text take no part; rows of one doc_id count as one document;
    further columns of `docs` are not looked at; no repeats give no rows.
    """
    bands, rows = minhash.band_plan(threshold, RECALL, MOST_HASHES)
    found = cut(units(docs, min_words, reach, bands, rows))
    classes = line_classes(found, docs, threshold)
    paragraphs = found.filter("is_line").select("key", "doc", "at", "n").join(classes, "key").select(F.lit("paragraph").alias("grain"), "doc", "at", "n", "k_doc", "k_at")
    inside = passages(found).select(F.lit("passage").alias("grain"), "doc", "at", "n", "k_doc", "k_at")
    away = (F.col("doc") != F.col("k_doc")) | (F.col("at") != F.col("k_at"))
    both = paragraphs.unionByName(inside)
    return both.select(
        F.col("doc").alias("doc_id"), "grain", F.col("at").alias("first_word"), F.col("n").alias("n_words"),
        F.col("k_doc").alias("kept_doc_id"), F.col("k_at").alias("kept_word"), away.alias("removed"),
    ).distinct()


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less its words in `spans` (first word, words); what separates the words of a span goes with them."""
    words = Words([text])
    keep = np.ones(len(words.points), bool)
    for first, n in spans:
        last = min(first + n, len(words.start)) - 1
        if first <= last:
            end = words.start[last + 1] if last + 1 < len(words.start) else len(keep)
            keep[words.start[first] : end] = False
    return words.points[keep].tobytes().decode("utf-32-le", "surrogatepass")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """`docs`, whatever its columns are called, with the removed stretches of repeats() taken out of text.

    Every row stays, with the text that is left (which may be empty) and, where
    there is one, an n_chars that fits it. Rows with a null id or text stay as
    they are; repeated rows lose the same words; an empty table stays empty.
    """
    gone = repeats(docs.select("doc_id", "text")).filter("removed")
    gone = cut(gone.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("first_word", "n_words")).alias("spans")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))

    @F.pandas_udf("string")
    def strip(texts, spans):  # pandas Series in and out
        kept = [t if s is None or t is None else without(t, [(x["first_word"], x["n_words"]) for x in s]) for t, s in zip(texts, spans)]
        return type(texts)(kept, index=texts.index, dtype=object)

    left = rows.join(gone, "id", "left").select("row", F.col("spans").isNotNull().alias("changed"), strip(F.col("text"), F.col("spans")).alias("text"))
    changed = {"text": F.col("text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("changed"), F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return left.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
