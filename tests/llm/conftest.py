import os
import pathlib
import re

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[2]
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, wordless and very long texts, repeated rows."""
    long = " ".join(f"word{i % 5000}" for i in range(30_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 35),
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 35),
        (2, "", None, None, None),
        (3, None, "en", "b", 0),
        (4, "!!! ... ???", "de", "b", 11),
        (5, "one two", None, "c", 7),
        (None, "alpha beta gamma delta epsilon zeta", "fr", None, 35),
        (6, long, "en", "c", len(long)),
        (7, long + " end", "en", "c", len(long) + 4),
        (8, "İstanbul 한국어 \U0001f600 naïve Σς", "tr", "d", 20),
    ]
    return spark.createDataFrame(rows, DOCS)


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def grams(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
