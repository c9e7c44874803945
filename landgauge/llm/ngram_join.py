"""N-gram Jaccard self-join by MinHash banding, verified on full n-gram sets.

Method: bands and rows are chosen for a target recall at the threshold; texts
of equal word sequences are one class; classes that share a band bucket are
tied to the bucket's smallest class; within each resulting candidate group all
pairs are verified on full n-gram sets, in pairs of bounded blocks, so a group
of any size is spread over many tasks and no pair is ever a row. A task gives
the number of links of each class and the edges of a spanning forest, from
which the components follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgauge.llm import minhash
from landgauge.llm.components import components
from landgauge.llm.scratch import cut, width
from landgauge.llm.text import Words, in_batches, list_array, shingles

N, THRESHOLD = 5, 0.8
RECALL, MOST_HASHES = 0.9995, 128
NO_ID = -(1 << 63)  # stands for a null id inside the joins


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """id, text_key, node (hash of the word sequence, null without words), weight (n-grams), keys (a long per band)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for begin, end, texts in in_batches(batch.column(1)):
                words = Words(texts)
                grams, offsets = shingles(words.hash, words.first, n)
                sizes = np.diff(offsets)
                some = sizes > 0
                keys = minhash.band_keys(grams, np.r_[offsets[:-1][some], offsets[-1]], bands, rows)
                ends = np.r_[0, np.cumsum(np.where(some, bands, 0))]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(begin, end - begin),
                        batch.column(2).slice(begin, end - begin),
                        pa.array(words.sequence_hash().view(np.int64), mask=~some),
                        pa.array(sizes),
                        list_array(keys.ravel(), ends),
                    ],
                    names=["id", "text_key", "node", "weight", "keys"],
                )

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_key")).mapInArrow(
        sign, "id long, text_key long, node long, weight long, keys array<long>"
    )


SET_SCHEMA = "grp long, b int, blocks int, node long, size long, grams array<long>"


def sets_of(texts: DataFrame, n: int) -> DataFrame:
    """Rows text, grp, b, blocks, node, size with grams, the sorted distinct n-gram hashes, in place of the text.

    Rows whose words are not those of `node` go.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, texts in in_batches(batch.column(0)):
                words = Words(texts)
                grams, offsets = shingles(words.hash, words.first, n)
                sets = [np.unique(grams[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
                part = batch.slice(begin, end - begin)
                out = pa.RecordBatch.from_arrays(
                    [*part.columns[1:], list_array(np.concatenate(sets).view(np.int64), np.r_[0, np.cumsum([len(s) for s in sets])])],
                    names=["grp", "b", "blocks", "node", "size", "grams"],
                )
                yield out.filter(pa.array(words.sequence_hash().view(np.int64) == part.column(4).to_numpy()))

    return texts.select("text", "grp", "b", "blocks", "node", "size").mapInArrow(gather, SET_SCHEMA)


def verify(members: DataFrame, threshold: float) -> DataFrame:
    """node, links, root: verified links of each member and its forest root, per pair of blocks.

    `members` grp, b, blocks, node, size (rows of the class), grams.
    """
    keys = ["grp", "bi", "bj"]
    dealt = minhash.block_pairs(members).select(*keys, "b", "node", "size", "grams")
    placed = dealt.repartition(width(dealt.sparkSession), *keys).sortWithinPartitions(*keys)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in minhash.by_group(batches, keys):
            node = group.column(4).to_numpy()
            _, once = np.unique(node, return_index=True)  # a repeated row of a class counts once
            node, size, block = node[once], group.column(5).to_numpy()[once], group.column(3).to_numpy()[once]
            grams = group.column(6)
            flat, ends = grams.values.to_numpy(), grams.offsets.to_numpy()
            sets = [flat[ends[i] : ends[i + 1]].view(np.uint64) for i in once]
            alike = minhash.linked(node, block, group.column(1)[0].as_py() == group.column(2)[0].as_py(), sets, threshold)
            some = alike.any(axis=1)
            if some.any():
                root = minhash.local_roots(alike)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[some]), pa.array((alike @ size)[some].astype(np.int64)), pa.array(node[root[some]])], names=["node", "links", "root"]
                )

    return placed.mapInArrow(judge, "node long, links long, root long")


def jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """One row per input row: id, node, class_id, class_size, n_links.

    Two rows are linked if the Jaccard similarity of their sets of n-word runs
    is `threshold` or more. class_id is the smallest id of the connected class,
    n_links the number of rows linked to this one (equal texts included),
    class_size the number of rows of the class. Further columns of `docs` are
    not looked at. Defined cases: a text of fewer than n words has one n-gram,
    all of its words; a text that is null or has no word is linked to nothing
    (node null, class_id its own id, n_links 0, class_size 1); rows with a null
    id take part and give no class its name; a repeated row counts as a row; an
    empty table gives an empty result. Words are compared by 64-bit hashes.
    """
    bands, rows = minhash.band_plan(threshold, recall, MOST_HASHES)
    rows_in = cut(signatures(docs, id_col, text_col, n, bands, rows))
    classes = cut(
        rows_in.filter("node is not null").groupBy("node").agg(
            F.min("id").alias("rep"), F.min(F.struct(F.coalesce("id", F.lit(NO_ID)).alias("id"), "text_key")).alias("row"),
            F.count(F.lit(1)).alias("size"), F.first("weight").alias("weight"), F.first("keys").alias("keys"),
        )
    )
    candidate = components(minhash.star_edges(classes.select("node", F.explode("keys").alias("bucket")), cut), cut)
    grouped = candidate.select("node", F.col("root").alias("grp")).unionByName(candidate.select(F.col("root").alias("node"), F.col("root").alias("grp")).distinct())
    members = cut(grouped.join(classes.select("node", "row", "size", "weight"), "node"))
    # one row stands for its class; null ids are many, so the text's hash is part of the key
    wanted = minhash.dealt_blocks(members, cut).select("row.id", "row.text_key", "grp", "b", "blocks", "node", "size")
    text = F.col(text_col).cast("string")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    # equal texts without an id would all stand for their class
    texts = texts.filter(F.col("id") != NO_ID).unionByName(texts.filter(F.col("id") == NO_ID).dropDuplicates(["text_key"]))
    # how many candidates there are follows the corpus, so the join is by shuffle at every size
    judged = cut(verify(sets_of(texts.join(wanted.hint("merge"), ["id", "text_key"]), n), threshold))
    links = judged.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(judged.select(F.col("node").alias("u"), F.col("root").alias("v")), cut)
    named = classes.select("node", "rep", "size").join(links, "node", "left").join(joined, "node", "left")
    named = cut(named.select("node", "rep", "size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")))
    totals = named.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("size").alias("class_size"))
    result = cut(named.join(totals, "root").select("node", "class_id", "class_size", (F.col("links") + F.col("size") - 1).alias("n_links")))
    return rows_in.select("id", "node").join(result, "node", "left").select(
        F.col("id").alias(id_col),
        "node",
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, whatever its columns are called, less near copies: of each class the row of the smallest id stays.

    Rows without a word and rows with a null id all stay. Of repeated rows of
    the id that stays, the row of the smallest text stays. An id names one
    document: all rows of an id that goes, go. An empty table stays empty.
    """
    classes = jaccard_join(docs.select(id_col, text_col), id_col, text_col).filter(F.col("class_size") > 1)
    gone = classes.filter(F.col(id_col) > F.col("class_id")).select(F.col(id_col).alias("id"), F.lit(0).alias("stay"))
    twice = classes.filter(F.col(id_col) == F.col("class_id")).groupBy(F.col(id_col).alias("id")).count().filter("count > 1").select("id", F.lit(1).alias("stay"))
    fate = cut(gone.unionByName(twice).groupBy("id").agg(F.min("stay").alias("stay")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    left = rows.join(fate, "id", "left").filter("stay is null or stay = 1")
    single = left.filter("stay is null").select("row.*")
    best = left.filter("stay = 1").groupBy("id").agg(F.min(F.struct("text", "row")).alias("best"))
    return single.unionByName(best.select("best.row.*"))
