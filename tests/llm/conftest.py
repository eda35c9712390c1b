from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


# Names that operators use inside, on columns of a caller's own.
CLASHING = ("row", "fp", "node", "root", "score", "kept", "n_words", "size", "part", "tokens", "base", "spans", "words",
            "base_failed", "host", "start", "rank", "sequence_id", "k", "y", "c")


@pytest.fixture(scope="session")
def edges(spark):
    """Documents with NULLs in any column, empty and very long texts, repeated rows and clashing columns."""
    long = " ".join(f"w{i % 7919}" for i in range(40_000))
    rows = [
        (1, "a b c d e f", "en", "h"), (1, "a b c d e f", "en", "h"), (2, "A B C D E F", "en", None),
        (3, None, None, None), (4, "", "en", "h"), (5, " \t\n\x0b ", "en", "h"), (None, "a b c d e f", "en", "h"),
        (None, None, None, None), (6, "one", "en", "h"), (7, long, "en", "g"), (8, "x\ny\nx\n\n\nx é中😀", "en", "g"),
        (9, "1" * 30_000 + " 1 1 1 " * 3_000 + "a" * 30_000 + "@", "en", "g"),
        (10, "mail a.b@c.de and 1.2.3.4, card 4111 1111 1111 1111, call +1 (555) 010-2030 now", "en", "g"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({name: F.lit("own") for name in CLASHING})


@pytest.fixture(scope="session")
def no_documents(edges):
    return edges.where("false")
