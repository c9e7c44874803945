"""Toxicity by class-conditional Kneser-Ney models.

Two models of the characters inside words, one of toxic and one of ordinary
text, share their lower orders: the full-order counts are those of the class,
what they leave over is spread by continuation counts of both classes together,
so an expression that a class has rarely seen backs off to what all text has.
Toxic text is taken as ordinary text in which a share TOXIC_SHARE of the words
comes from the toxic model; otherwise the smaller toxic sample would make every
ordinary word look unlikely. A document's measure is the difference of the two
log-likelihoods divided by its number of words, turned into a probability by a
logistic curve fitted on labelled documents that the models have not seen.

Every log ratio counts. Up to MOST_ENTRIES of them are held by every task; more are
joined to the characters of the words, and the words to the texts.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgauge.llm.scratch import cut
from landgauge.llm.text import U64, Words, in_batches, mix, segment_hash, tables

ORDER, DISCOUNT, LOWER_DISCOUNT, TOXIC_SHARE = 7, 0.9, 0.75, 0.01
NO_ID = -(1 << 63)  # stands for a null id inside joins
SLOT_BITS = 22  # of a hash, to find an entry of the model
MOST_ENTRIES = 1 << 22  # log ratios that go through the driver to every task; more are joined
BEGIN, END = "\x02", "\x03"  # stand before and after a word
BINS = 20_000  # per unit of the measure, for the curve


def remainder(id_col: str, of: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(of))


# ---- counts ----------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n0, n1 over rows text, y (0 or 1)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_numpy()
            for begin, _, texts in in_batches(batch.column(0)):
                words = Words(texts)
                unique, first, place = np.unique(words.hash, return_index=True, return_inverse=True)
                y = labels[begin + words.text]
                n1 = np.bincount(place, weights=y, minlength=len(unique)).astype(np.int64)
                n = np.bincount(place, minlength=len(unique))
                lower = tables()[0][words.points].tobytes().decode("utf-32-le", "replace")
                names = [lower[a:b] for a, b in zip(words.start[first], words.end[first])]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n - n1), pa.array(n1)], names=["word", "n0", "n1"])

    found = texts.select(F.col("text").cast("string").alias("text"), F.col("y").cast("int").alias("y")).mapInArrow(count, "word string, n0 long, n1 long")
    return found.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def gram_counts(words: DataFrame, order: int) -> DataFrame:
    """g, n0, n1: every character of every word (and its end) with the up to order - 1 before it, the word's beginning included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for word, n0, n1 in zip(*(c.to_pylist() for c in batch.columns)):
                s = BEGIN + word + END
                for i in range(1, len(s)):
                    pair = sums[s[max(0, i - order + 1) : i + 1]]
                    pair[0] += n0
                    pair[1] += n1
            if sums:
                n0, n1 = zip(*sums.values())
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(n0, pa.int64()), pa.array(n1, pa.int64())], names=["g", "n0", "n1"])

    return words.select("word", "n0", "n1").mapInArrow(count, "g string, n0 long, n1 long").groupBy("g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def shared_probabilities(full: DataFrame, order: int) -> DataFrame:
    """g, p for all grams shorter than `order` that end a longer one: Kneser-Ney over continuation counts of both classes."""
    d = LOWER_DISCOUNT
    ends = full.select(F.expr("explode(transform(sequence(1, length(g) - 1), i -> substring(g, i)))").alias("g")).distinct()
    counts = cut(ends.groupBy(F.expr("substring(g, 2)").alias("g")).agg(F.count(F.lit(1)).alias("c")).withColumn("h", F.expr("substring(g, 1, length(g) - 1)")))
    # a history of m - 1 characters is one of grams of m characters, so all lengths are summed at once
    sums = counts.groupBy("h").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))
    base = cut(counts.join(sums, "h").select("g", "c", "total", "kinds"))
    lower, parts = None, []
    for m in range(1, order):
        rows = base.filter(F.length("g") == m)
        if lower is None:
            rows = rows.withColumn("back", 1 / (F.col("kinds") + 1))
        else:
            rows = rows.withColumn("tail", F.expr("substring(g, 2)")).join(lower.select(F.col("g").alias("tail"), F.col("p").alias("back")), "tail")
        lower = cut(rows.select("g", ((F.greatest(F.col("c") - d, F.lit(0.0)) + d * F.col("kinds") * F.col("back")) / F.col("total")).alias("p")))
        parts.append(lower)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def log_ratios(full: DataFrame, order: int) -> DataFrame:
    """key, n, value: log P(toxic model) - log P(ordinary model) of each gram seen, and of each history for what was not seen after it."""
    history = F.expr("substring(g, 1, length(g) - 1)")
    d = F.lit(DISCOUNT)
    sums = cut(
        full.groupBy(history.alias("h")).agg(
            *[F.sum(n).alias(f"t{n}") for n in ("n0", "n1")], *[F.sum(F.least(F.col(n).cast("double"), d)).alias(f"d{n}") for n in ("n0", "n1")]
        )
    )
    shared = shared_probabilities(full, order).select(F.col("g").alias("tail"), F.col("p").alias("back"))
    rows = full.withColumn("h", history).withColumn("tail", F.expr("substring(g, 2)")).join(sums, "h").join(shared, "tail")

    def log_p(n: str) -> Column:
        seen = (F.greatest(F.col(n) - d, F.lit(0.0)) + F.col(f"d{n}") * F.col("back")) / F.col(f"t{n}")
        return F.log(F.when(F.col(f"t{n}") > 0, seen).otherwise(F.col("back")))

    def log_left(n: str) -> Column:
        return F.when(F.col(f"t{n}") > 0, F.log(F.col(f"d{n}") / F.col(f"t{n}"))).otherwise(0.0)

    # a gram seen once is scored as not seen after its history, which keeps the model small
    grams = rows.filter(F.col("n0") + F.col("n1") > 1).select(F.concat(F.lit("g"), "g").alias("key"), (F.col("n0") + F.col("n1")).alias("n"), (log_p("n1") - log_p("n0")).alias("value"))
    histories = sums.select(F.concat(F.lit("h"), "h").alias("key"), (F.col("tn0") + F.col("tn1")).alias("n"), (log_left("n1") - log_left("n0")).alias("value"))
    return grams.unionByName(histories)


# ---- the model -------------------------------------------------------------


def key_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str) -> np.ndarray:
    return mix(segment_hash(points + np.uint32(1), starts, ends) + U64(ord(kind)))


class Model:
    """Log ratios by the 64-bit hash of their key, sorted; the hash's first SLOT_BITS bits tell where to look."""

    def __init__(self, order: int, hashes: np.ndarray, values: np.ndarray) -> None:
        self.order, self.shift = order, U64(64 - SLOT_BITS)
        by = np.argsort(hashes)
        self.hash, self.value = hashes[by], values[by]
        self.first = np.r_[0, np.cumsum(np.bincount((self.hash >> self.shift).astype(np.int64), minlength=1 << SLOT_BITS))].astype(np.int32)

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = (hashes >> self.shift).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        known, value = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.float32)
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            hit = self.hash[here] == hashes[left]
            known[left[hit]], value[left[hit]] = True, self.value[here[hit]]
            at[left] += 1
            left = left[~hit & (here + 1 < end[left])]
        return known, value

    def score_words(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log of (toxic text / ordinary text) of each word, its end included; `points` are lower-cased."""
        sizes = ends - starts + 2
        edge = np.r_[0, np.cumsum(sizes)]
        chars = np.empty(edge[-1], np.uint32)
        inner = np.arange(edge[-1]) - np.repeat(edge[:-1], sizes)
        chars[:] = points[np.clip(np.repeat(starts, sizes) + inner - 1, 0, len(points) - 1)]
        chars[edge[:-1]], chars[edge[1:] - 1] = ord(BEGIN), ord(END)
        at = np.flatnonzero(inner > 0)
        begin = np.maximum(at - self.order + 1, np.repeat(edge[:-1], sizes)[at])
        known, value = self.look(key_hashes(chars, begin, at + 1, "g"))
        known_h, left = self.look(key_hashes(chars, begin, at, "h"))
        out = np.zeros(edge[-1])
        out[at] = np.where(known, value, np.where(known_h, left, 0.0))
        ratio = np.add.reduceat(out, edge[:-1]) if len(starts) else np.zeros(0)
        return np.logaddexp(math.log(TOXIC_SHARE) + ratio, math.log1p(-TOXIC_SHARE))

    def score_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log ratio, words) of each text."""
        words = Words(texts)
        unique, first, place = np.unique(words.hash, return_index=True, return_inverse=True)
        lower = tables()[0][words.points]
        each = self.score_words(lower, words.start[first], words.end[first])[place] if len(unique) else np.zeros(0)
        ratio = np.bincount(words.text, weights=each, minlength=len(texts))
        return ratio, np.diff(words.first)


def gather_model(ratios: DataFrame, order: int) -> Model:
    """All log ratios, 12 bytes each through the driver; meant for up to MOST_ENTRIES rows."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            points = np.frombuffer("".join(k[1:] for k in keys).encode("utf-32-le", "surrogatepass"), np.uint32)
            edge = np.r_[0, np.cumsum([len(k) - 1 for k in keys])].astype(np.int64)
            grams, histories = (key_hashes(points, edge[:-1], edge[1:], kind) for kind in "gh")
            hashes = np.where(np.array([k[0] == "g" for k in keys], bool), grams, histories)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column(1)], names=["hash", "value"])

    placed = ratios.select("key", "value").mapInArrow(place, "hash long, value double")
    found = placed.select("hash", F.col("value").cast("float").alias("value")).toArrow()
    return Model(order, found.column(0).to_numpy().view(U64), found.column(1).to_numpy())


def rate_by_model(texts: DataFrame, model: Model) -> DataFrame:
    """doc_id, key, x of texts (doc_id, text, key): the measure of each by a model that every task holds."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, own in in_batches(batch.column(1)):
                ratio, length = shared.value.score_texts(own)
                ids = [batch.column(k).slice(begin, end - begin) for k in (0, 2)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(ratio / np.maximum(length, 1))], names=["doc_id", "key", "x"])

    return texts.select("doc_id", "text", "key").mapInArrow(rate, "doc_id long, key long, x double")


def words_of_texts(texts: DataFrame) -> DataFrame:
    """digest, word, n: how often each word stands in each text (rows digest, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, own in in_batches(batch.column(1)):
                words = Words(own)
                if not len(words.text):
                    continue
                order = np.lexsort((words.hash, words.text))
                text, hashes = words.text[order], words.hash[order]
                first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])])
                lower = tables()[0][words.points].tobytes().decode("utf-32-le", "replace")
                names = [lower[a:b] for a, b in zip(words.start[order[first]], words.end[order[first]])]
                digest = batch.column(0).slice(begin, end - begin).take(pa.array(text[first]))
                yield pa.RecordBatch.from_arrays([digest, pa.array(names, pa.string()), pa.array(np.diff(np.r_[first, len(text)]))], names=["digest", "word", "n"])

    return texts.select("digest", "text").mapInArrow(count, "digest binary, word string, n long")


def word_ratios(words: DataFrame, ratios: DataFrame, order: int) -> DataFrame:
    """word, ratio: Model.score_words of distinct words, by joins with the log ratios."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word in batch.column(0).to_pylist():
                s = BEGIN + word + END
                for i in range(1, len(s)):
                    start = max(0, i - order + 1)
                    rows.append((word, "g" + s[start : i + 1], "h" + s[start:i]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["word", "g", "h"])

    seen, left = (ratios.select(F.col("key").alias(k), F.col("value").alias(f"v{k}")) for k in "gh")
    rows = words.select("word").mapInArrow(grams, "word string, g string, h string").join(seen, "g", "left").join(left, "h", "left")
    toxic = F.sum(F.coalesce("vg", "vh", F.lit(0.0))) + math.log(TOXIC_SHARE)
    both = rows.groupBy("word").agg(toxic.alias("_t")).withColumn("_o", F.lit(math.log1p(-TOXIC_SHARE)))
    return both.select("word", (F.greatest("_t", "_o") + F.log1p(F.exp(-F.abs(F.col("_t") - F.col("_o"))))).alias("ratio"))


def rate_by_joins(texts: DataFrame, ratios: DataFrame, order: int) -> DataFrame:
    """The rows of rate_by_model, whatever the number of log ratios: nothing is held whole by a task or the driver."""
    own = texts.withColumn("digest", F.unhex(F.md5("text")))
    # repeated texts repeat their words, which does not change a mean
    words = cut(words_of_texts(own))
    each = word_ratios(words.select("word").distinct(), ratios, order)
    x = words.join(each, "word").groupBy("digest").agg((F.sum(F.col("n") * F.col("ratio")) / F.sum("n")).alias("x"))
    return own.join(x, "digest", "left").select("doc_id", "key", F.coalesce("x", F.lit(0.0)).alias("x"))


def fit_curve(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """(slope, shift) of the logistic curve over (x, ordinary, toxic) counts; slightly held back, so it exists for any counts."""
    if not bins:
        return 1.0, 0.0
    x = np.array([b[0] for b in bins])
    n, y = np.array([b[1] + b[2] for b in bins], float), np.array([b[2] for b in bins], float)
    scale = max(float(np.sqrt((n * x * x).sum() / n.sum())), 1e-9)
    design = np.stack([x / scale, np.ones_like(x)], axis=1)
    theta = np.array([1.0, math.log((y.sum() + 0.5) / (n.sum() - y.sum() + 0.5))])
    hold = np.diag([0.05, 0.01])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -40, 40)))
        grad = design.T @ (y - n * p) - hold @ theta
        step = np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + hold, grad)
        size = float(np.abs(step).max())
        theta = theta + step * min(1.0, 4.0 / max(size, 1e-12))
        if size < 1e-9:
            break
    return float(theta[0] / scale), float(theta[1])


# ---- the operator ----------------------------------------------------------


def score(docs: DataFrame, labels: DataFrame, order: int = ORDER, with_key: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs`.

    `labels` (doc_id, toxic 0 or 1) count where crc32 of the id as text is not
    divisible by 5 (those are held out): remainders 1 to 3 train the models,
    remainder 4 the curve. Other label values and null ids teach nothing; of
    several labels of one id the largest counts. A null or empty text, and one
    without a word, has a measure of 0. Without any labelled
    text every score is 0.5. Extra columns are not looked at. With `with_key` the hash of the text comes along as key.
    """
    marks = cut(
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", 5) != 0))
        .groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
        .withColumn("part", remainder("_id", 5).cast("int"))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    learn = texts.join(marks.filter("part < 4").hint("merge"), F.col("doc_id") == F.col("_id")).select("text", "y")
    full = cut(gram_counts(cut(word_counts(learn)), order))
    ratios = cut(log_ratios(full, order))
    texts = texts.withColumn("key", F.xxhash64("text"))
    rated = cut(rate_by_model(texts, gather_model(ratios, order)) if ratios.count() <= MOST_ENTRIES else rate_by_joins(texts, ratios, order))
    seen = rated.join(marks.filter("part = 4"), F.col("doc_id") == F.col("_id"))
    bins = seen.groupBy(F.round(F.least(F.greatest("x", F.lit(-1.0)), F.lit(1.0)) * BINS).cast("int").alias("bin")).agg(
        F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1")
    ).collect()  # at most 2 * BINS + 1 rows
    slope, shift = fit_curve([(r.bin / BINS, r.n0, r.n1) for r in sorted(bins)])
    p = 1 / (1 + F.exp(-(F.col("x") * F.lit(slope) + F.lit(shift))))
    return rated.select(
        *(["key"] if with_key else []), "doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), p.alias("score"), F.when(p >= 0.5, 1).otherwise(0).alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, whatever its columns are called, that score() does not predict toxic; each row is judged by its own text.

    Rows with a null id and repeated rows are judged like any other; an empty table stays empty.
    """
    kind = F.col("doc_id").cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # rows of one id and one text have one score
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(kind, F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("key"))
    bad = score(docs.select("doc_id", "text"), labels, with_key=True).filter("predicted = 1")
    bad = cut(bad.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "key").distinct())
    return rows.join(bad, ["id", "key"], "left_anti").select("row.*")
