"""The corpus pipeline: stages over `documents`, each applying one of the operators in landgauge.llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgauge.llm import mixing, ngram_join, packing, substring, toxicity
from landgauge.llm.scratch import cut, prepare

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


# Weights of well and badly written text in the mixed corpus.
QUALITY_WEIGHTS = {"good": 0.9, "low": 0.1}


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier toxic than not go."""
    return toxicity.drop_toxic(docs, labels_of(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id."""
    prepare(spark)
    return ngram_join.drop_near_copies(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stretches of text that stand in several documents stay in the first of them only; every document stays."""
    prepare(spark)
    return substring.drop_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and some again, so that the token totals come to QUALITY_WEIGHTS."""
    labels = labels_of(spark, sf_dir)
    domain = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "low")
    rated = mixing.mix(docs, labels.select("doc_id", domain.alias("domain")), QUALITY_WEIGHTS, low=1.0, keep_all=True)
    return mixing.apply_copies(docs, rated)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their places in sequences of at most 4096 tokens."""
    prepare(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of `sf_dir`, each written and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
