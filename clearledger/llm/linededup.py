"""Lines that many documents share, dropped from all of them but one."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearledger.llm.common import BLANKS, columns_of, stored

# A line is dropped if its key has so many code points and stands in so many documents.
MIN_CHARS, MIN_DOCS = 20, 3
# A line in more than one of so many pairs of line and document is joined by broadcast: there are at most as many.
HOT = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_hash(line: str) -> bytes:
    """The hash of a line's key, as the scan computes it: bytes change case only in A-Z and strip only ASCII blanks."""
    return hashlib.md5(line.encode().strip().lower(), usedforsecurity=False).digest()


def _pairs(docs: DataFrame, min_chars: int) -> DataFrame:
    """``hash, doc_id``, once each, of all lines long enough."""
    lines = docs.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    keyed = lines.select("doc_id", F.btrim("line", F.lit(BLANKS)).alias("key")).where(F.length("key") >= min_chars)
    hashed = F.unhex(F.md5(F.translate("key", UPPER, LOWER)))
    return keyed.select(hashed.alias("hash"), "doc_id").distinct()


def shared_lines(pairs: DataFrame, min_docs: int) -> DataFrame:
    """``hash, n, keeper``: the lines of at least ``min_docs`` documents and the largest doc_id that holds each."""
    counted = pairs.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
    return counted.where(F.col("n") >= min_docs)


def _drops(pairs: DataFrame, shared: DataFrame, total: int) -> DataFrame:
    """``doc_id, hashes``: what each document loses.

    The lines of a thousandth of all pairs or more are a thousand at most, whatever the input: they are broadcast, and
    the pairs of no other line are many enough to hold up the task they meet in.
    """
    hot = F.broadcast(shared.where(F.col("n") * HOT > total))
    rest = shared.where(F.col("n") * HOT <= total)
    met = pairs.join(hot, "hash").unionByName(pairs.join(hot, "hash", "left_anti").join(rest, "hash"))
    lost = met.where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id").agg(F.collect_list("hash").alias("hashes"))


def _rebuilt(texts: pd.Series, hashes: pd.Series) -> pd.DataFrame:
    """The lines of each text that are kept, in their order."""
    n_lines, n_dropped, kept_texts = [], [], []
    for text, lost in zip(texts, hashes, strict=True):
        if lost is None or not len(lost):
            n_lines.append(text.count("\n") + 1)
            n_dropped.append(0)
            kept_texts.append(text)
            continue
        gone = set(lost)
        lines = text.split("\n")
        kept = [line for line in lines if line_hash(line) not in gone]
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(kept))
        kept_texts.append("\n".join(kept))
    counts = {"n_lines": np.array(n_lines, np.int64), "n_dropped": np.array(n_dropped, np.int64)}
    return pd.DataFrame({**counts, "text": pd.Series(kept_texts, dtype=object)})


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` for each row: its text without the lines that many documents share.

    Lines are what ``\\n`` divides. A line's key is the line without blanks at its ends and with A-Z in lower case; one of
    at least ``min_chars`` code points that stands in at least ``min_docs`` documents stays in the document with the largest doc_id
    alone, there as often as it is repeated. Keys are compared by 128 bits of hash. What a document loses is joined to its row,
    whose lines are gone through in order, so no text is taken apart across tasks.

    A NULL or empty text is one empty line. Rows with equal doc_id, NULL included, are one document for the count and each give a row;
    a NULL doc_id is smaller than any other. The keeper of a key is unique, so there are no ties. Texts of any length
    are read whole. An empty table gives no rows. Columns besides the two named are not read.
    """
    rows = columns_of(docs, doc_id=key, text=text)
    pairs = stored(_pairs(rows, min_chars), "lines-pairs")
    shared = stored(shared_lines(pairs, min_docs), "lines-shared")
    drops = stored(_drops(pairs, shared, pairs.count()), "lines-drops")
    drops = drops.select(F.col("doc_id").alias("of"), "hashes")
    joined = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("of")), "left")
    rebuilt = F.pandas_udf(_rebuilt, "n_lines long, n_dropped long, text string")
    made = joined.select("doc_id", rebuilt(F.coalesce("text", F.lit("")), "hashes").alias("made"))
    return made.select("doc_id", "made.text", "made.n_lines", "made.n_dropped")
