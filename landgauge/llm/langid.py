"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Method: n-grams of one to three characters are hashed to a fixed number of
features; document frequencies are counted over all learnable texts; the
weights are fitted on a bounded sample per language by follow-the-regularised-
leader with elastic-net penalties, which keeps them sparse, in shards whose
states are averaged after each pass; a temperature fitted on texts kept out of
the fit turns the logits into calibrated probabilities. Whole texts are read
everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgauge.llm.minhash import by_group
from landgauge.llm.scratch import cut
from landgauge.llm.text import U64, code_points, in_batches, list_array, mix, tables

FEATURE_BITS, LONGEST = 15, 3
# bounds of the fit: texts per language in the sample, and per shard
SAMPLE_PER_LANGUAGE, SHARD_TEXTS = 500, 2000
PASSES, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 1e-4, 1e-4
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """Lower-case code point of each letter, a space for everything else."""
    lower, _ = tables()
    is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.where(is_letter, lower, np.uint32(32)).astype(np.uint32)


def counts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(features, their counts, has a letter) of each text."""
    raw, offsets = code_points(texts)
    points = letters()[raw]
    letter = np.r_[0, np.cumsum(points != 32)]
    hashed, code = [], np.zeros(len(points), U64)
    for n in range(1, LONGEST + 1):
        size = len(points) - n + 1
        if size <= 0:
            break
        code = code[:size] * U64(0x100000001B3) + points[n - 1 :].astype(U64)
        hashed.append((mix(code + U64(n)) >> U64(64 - FEATURE_BITS)).astype(np.int32))
    for a, b in zip(offsets[:-1], offsets[1:]):
        grams = [h[a : max(a, b - n)] for n, h in enumerate(hashed)]
        total = np.bincount(np.concatenate(grams), minlength=1 << FEATURE_BITS) if b > a else np.zeros(1 << FEATURE_BITS, np.int64)
        at = np.flatnonzero(total)
        yield at, total[at], bool(letter[b] > letter[a])


def tf_idf(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(count)) * idf[at]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that have each feature, documents) over the rows text; one row per feature and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros((1 << FEATURE_BITS) + 1, np.int64), 0
        for batch in batches:
            for _, _, part in in_batches(batch.column(0)):
                for at, _, _ in counts(part):
                    total[at] += 1
                    docs += 1
        total[-1] = docs
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["feature", "n"])

    sums = texts.mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((1 << FEATURE_BITS) + 1, np.int64)
    out[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
    return out[:-1], int(out[-1])


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of a follow-the-regularised-leader state; zero where the evidence is below the L1 penalty."""
    step = (BETA + np.sqrt(n)) / ALPHA + L2
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / step)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def learn_shard(z: np.ndarray, n: np.ndarray, examples: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """One pass over the examples (features, values, class), in place. The last feature is the bias."""
    for at, x, y in examples:
        w = weights_of(z[at], n[at])
        error = softmax(x @ w)
        error[y] -= 1
        grad = x[:, None] * error
        grown = n[at] + grad * grad
        z[at] += grad - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
        n[at] = grown


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least log loss, by golden section over its logarithm.

    One text's worth of even doubt is added, so a few texts that are all told
    right don't make the model certain.
    """
    if not len(y):
        return 1.0
    wanted = np.full(logits.shape, 1.0 / logits.shape[1] / (len(y) + 1))
    wanted[np.arange(len(y)), y] += len(y) / (len(y) + 1)

    def loss(t: float) -> float:
        return float(-(wanted * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-300))).sum(axis=1).mean())

    a, b, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Classifier:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temp: float) -> None:
        self.languages, self.idf, self.weights, self.temp = languages, idf, weights, temp

    def logits(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        return tf_idf(at, count, self.idf) @ self.weights[at] + self.weights[-1]

    def predict(self, texts: list[str]) -> Iterator[tuple[str, float]]:
        for at, count, lettered in counts(texts):
            if not lettered or not self.languages:
                yield UNKNOWN, 0.0
                continue
            p = softmax(self.logits(at, count) / self.temp)
            best = int(p.argmax())
            yield self.languages[best], float(p[best])


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Classifier:
    """A classifier from rows id, text, lang (all non-null).

    Document frequencies cover every row. The weights and the temperature come
    from a sample of about `per_language` texts of each language, chosen by
    the hash of the id, a fifth of it kept for the temperature.
    """
    frequency, docs = document_frequencies(labelled.select("text"))
    idf = np.log((1 + docs) / (1 + frequency)) + 1
    sizes = cut(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")))
    languages = sorted(r.lang for r in sizes.collect())
    if not languages:
        return Classifier([], idf, np.zeros((len(idf) + 1, 0)), 1.0)
    chance = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = labelled.join(F.broadcast(sizes), "lang").filter(chance * F.col("_n") < per_language)  # one row per language
    index = {name: i for i, name in enumerate(languages)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, keys = batch.column(1).to_pylist(), batch.column(2)
            for begin, end, texts in in_batches(batch.column(0)):
                found = [(at, tf_idf(at, c, idf)) for at, c, _ in counts(texts)]
                edge = np.r_[0, np.cumsum([len(at) for at, _ in found])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([index[x] for x in langs[begin:end]], pa.int32()), keys.slice(begin, end - begin),
                        list_array(np.concatenate([at for at, _ in found]).astype(np.int32), edge), list_array(np.concatenate([x for _, x in found]).astype(np.float32), edge),
                    ],
                    names=["y", "key", "at", "x"],
                )

    key = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)).cast("int")
    sample = cut(chosen.select("text", "lang", key.alias("key")).mapInArrow(vectors, "y int, key int, at array<int>, x array<float>"))
    n_fit = sample.filter("key % 5 <> 0").count()
    shards = max(1, -(-n_fit // SHARD_TEXTS))
    dealt = cut(sample.filter("key % 5 <> 0").withColumn("shard", F.pmod(F.col("key"), F.lit(shards)).cast("int")))
    z, n = (np.zeros((len(idf) + 1, len(languages)), np.float64) for _ in range(2))
    for number in range(PASSES):

        def learn(batches: Iterator[pa.RecordBatch], z0: np.ndarray = z, n0: np.ndarray = n, number: int = number) -> Iterator[pa.RecordBatch]:
            for group in by_group(batches, ["shard"]):
                order = np.lexsort((group.column(1).to_numpy(), (group.column(1).to_numpy().astype(np.int64) * (2 * number + 3)) % 1009))
                y = group.column(0).to_numpy()
                ends, at, x = group.column(2).offsets.to_numpy(), group.column(2).values.to_numpy(), group.column(3).values.to_numpy()
                bias = np.array([len(z0) - 1])
                examples = [(np.r_[at[ends[i] : ends[i + 1]], bias], np.r_[x[ends[i] : ends[i + 1]].astype(np.float64), 1.0], int(y[i])) for i in order]
                own_z, own_n = z0.copy(), n0.copy()
                learn_shard(own_z, own_n, examples)
                yield pa.RecordBatch.from_arrays([pa.array([own_z.tobytes()]), pa.array([own_n.tobytes()])], names=["z", "n"])

        states = dealt.repartition(shards, "shard").sortWithinPartitions("shard").select("y", "key", "at", "x", "shard").mapInArrow(learn, "z binary, n binary")
        got = states.collect()  # a state per shard; the sample bounds the shards
        z = np.mean([np.frombuffer(r.z, np.float64).reshape(z.shape) for r in got], axis=0) if got else z
        n = np.mean([np.frombuffer(r.n, np.float64).reshape(n.shape) for r in got], axis=0) if got else n
    model = Classifier(languages, idf, weights_of(z, n), 1.0)
    kept = sample.filter("key % 5 = 0").toArrow()  # a fifth of the sample
    weights, logits = model.weights, np.zeros((kept.num_rows, len(languages)))
    for i, (at, x) in enumerate(zip(kept.column("at"), kept.column("x"))):
        logits[i] = np.asarray(x.values) @ weights[np.asarray(at.values)] + weights[-1]
    model.temp = temperature(logits, kept.column("y").to_numpy())
    return model


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of `docs` (doc_id, text, lang).

    Learns from rows with a text and a lang whose crc32 of the id as text is
    not 2 modulo 4; no prediction looks at lang, source or the id. A null text
    and a text without a letter is `und` with score 0, and so is every text
    when nothing can be learnt. Rows with a null id are not learnt from. Equal
    texts get equal predictions; further columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(rows.filter(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("id")), per_language)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, texts in in_batches(batch.column(1)):
                names, scores = zip(*shared.value.predict(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    found = rows.select("id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
