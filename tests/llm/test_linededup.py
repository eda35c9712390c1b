from __future__ import annotations

from collections import defaultdict

import pytest
from comparing import differences
from pyspark.sql import functions as F

from clearledger.llm import linededup, queries

BLANKS = " \t\n\x0b\x0c\r"
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def key(line):
    return line.strip(BLANKS).translate(UPPER)


def expected(rows, min_chars=20, min_docs=3):
    """(doc_id, n_lines, n_dropped, text) for every row."""
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    shared = {k: v for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    keeper = {k: max(d for d in v if d is not None) for k, v in shared.items()}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(df):
    rows = df.collect()
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in rows), key=repr)


def test_query_equals_sql(spark, folder):
    df = queries.QUERIES["op12_line_dedup"](spark, folder)
    assert differences(df, queries.ORACLES["op12_line_dedup"], folder) == ""


def test_equals_brute_force(documents):
    pairs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert found(linededup.dedup_lines(documents)) == expected(pairs)


SHARED = "a line that many documents share"
ROWS = [
    (1, f"first\n{SHARED}\nlast"), (2, f"  {SHARED.upper()}\t\n{SHARED}\n"), (3, f"{SHARED}\n\n{SHARED}"), (4, "own\n" * 3),
    (5, "exactly twenty chars\nonly nineteen chars"), (6, "EXACTLY TWENTY CHARS \nonly nineteen chars"),
    (7, "exactly twenty chars\nonly nineteen chars"),  # 20 and 19 code points
    (8, "in two documents alone, twice\nin two documents alone, twice"), (9, "in two documents alone, twice"),
    (10, "é" * 20), (11, "é" * 20), (12, "É" * 20), (13, "é" * 20),  # only A-Z change case
    (14, "a space in the middle that is no blank "), (15, "a space in the middle that is no blank"),
    (16, "a space in the middle that is no blank"), (17, "a space in the middle that is no blank"),
    (18, None), (19, ""), (20, "\r\n\r\n"), (None, f"{SHARED}\nmine"), (None, f"{SHARED}\nmine too"),
    (21, "repeated rows are one document"), (21, "repeated rows are one document"), (22, "repeated rows are one document"),
]
SCHEMA = "doc_id long, text string"


def test_keys_and_counts(spark):
    got = found(linededup.dedup_lines(spark.createDataFrame(ROWS, SCHEMA)))
    assert got == expected(ROWS)
    text = {doc: t for doc, _, _, t in got}
    assert text[1] == "first\nlast" and text[3] == ROWS[2][1] and text[2] == ""
    assert text[5] == "only nineteen chars" and text[9] == ROWS[8][1] and text[21] == ROWS[-1][1]
    assert text[12] == "É" * 20 and text[10] == ""


def test_other_limits(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert found(linededup.dedup_lines(df, min_chars=1, min_docs=2)) == expected(ROWS, 1, 2)


@pytest.mark.parametrize("hot", [2, 1024, 10**9])
def test_a_line_of_a_third_of_all_pairs(spark, monkeypatch, hot):
    """The same whether a line is joined by broadcast or by shuffle."""
    monkeypatch.setattr(linededup, "HOT", hot)
    rows = [(i, f"{SHARED}\nline of document {i % 40} and others\n{i}") for i in range(300)]
    assert found(linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_edges(edges, no_documents):
    got = linededup.dedup_lines(edges)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    assert found(got) == expected(rows)
    assert linededup.dedup_lines(no_documents).count() == 0
    other = edges.select(F.col("doc_id").alias("a key"), F.col("text").alias("body"), F.lit(1).alias("text"), F.lit(2).alias("hash"))
    assert found(linededup.dedup_lines(other, "a key", "body")) == expected(rows)
