"""Where the runnable queries and their SQL counterparts are collected."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from landgauge.session import configure

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Attribute access to the parquet tables of one scale folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers `fn(tables) -> DataFrame` under `name` with its DuckDB counterpart."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(configure(spark), folder))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


MODULES = (
    "prices",
    "clean",
    "classify",
    "ranking",
    "geometry",
    "joins",
    "aggregates",
    "filters",
    "sources",
    "graphs",
    "marts",
    "profiles",
)


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"landgauge.catalog.{module}")
