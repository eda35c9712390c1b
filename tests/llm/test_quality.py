from __future__ import annotations

import brute
import pytest
from comparing import differences
from pyspark.sql import functions as F

from clearledger.llm import quality, queries


def counts(df, text="text"):
    for r in df.collect():
        got = tuple(r[m] for m in quality.MEASURES)
        assert got == brute.quality(r[text]), (r["doc_id"], got)


def test_query_equals_sql(spark, folder):
    df = queries.QUERIES["op5_quality_rules"](spark, folder)
    assert differences(df, queries.ORACLES["op5_quality_rules"], folder) == ""


def test_counts(documents, edges):
    counts(quality.measured(documents.select("doc_id", "text")))
    counts(quality.measured(edges.select("doc_id", "text")))


@pytest.mark.parametrize("n", [3, 4, 5, 8, 9, 64, 65])
def test_repeats_of_any_length(spark, n):
    rows = [(i, " ".join(w)) for i, w in enumerate((["a"] * n, list("abcabc" * n)[:n], [f"w{j}" for j in range(n)]))]
    counts(quality.measured(spark.createDataFrame(rows, "doc_id long, text string")))


def test_verdicts(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good, f"good{i % 5}") for i in range(50)] + [(100 + i, "bad", "bad") for i in range(40)]
    rows += [(200, good, "bad"), (201, good, None), (202, None, None), (300, "short", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.judged(docs, keep=("doc_id",)).collect()}
    assert got[0] == (False, True) and got[100] == (True, False)
    assert got[200] == (False, False)  # a host that nearly always fails takes its good pages along
    assert got[201] == (False, True) and got[202] == (True, False)
    kept = quality.passing(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, v in got.items() if v[1]}


def test_shrinking_pulls_small_hosts_to_the_mean(spark):
    rows = [(f"h{i}", j < i) for i in range(1, 9) for j in range(100)] + [("new", True)]
    flagged = spark.createDataFrame(rows, "source string, failed boolean")
    rates = {r["host"]: r["failed_rate"] for r in quality.host_rates(flagged, "source", ["failed"]).collect()}
    assert rates["h8"] == pytest.approx(0.08, abs=0.02)
    assert 0.1 < rates["new"] < 0.9


@pytest.mark.parametrize("large", [0, 1000])
def test_hosts_of_one_document_are_judged_by_what_is_usual(spark, large):
    """One in five of 200 fails; a host of many documents among them keeps its own rate."""
    rows = [(f"h{i}", i % 5 == 0) for i in range(200)] + [("large", j % 10 > 0) for j in range(large)]
    flagged = spark.createDataFrame(rows, "source string, failed boolean")
    rates = {r["host"]: r["failed_rate"] for r in quality.host_rates(flagged, "source", ["failed"]).collect()}
    assert all(rates[f"h{i}"] < 0.5 for i in range(200))
    if large:
        assert rates["large"] == pytest.approx(0.9, abs=0.08)
    else:
        assert rates["h0"] == pytest.approx(0.2, abs=0.02)
        assert quality.rejected_hosts(flagged, "source", {"failed": 0.5}).isEmpty()


def test_edges(edges, no_documents):
    judged = quality.judged(edges, keep=("doc_id",))
    assert judged.count() == edges.count()
    assert judged.where(F.col("kept") & F.col("base_failed")).count() == 0
    kept = quality.passing(edges)
    assert kept.columns == edges.columns and kept.count() == 0  # all are short or repeat themselves
    assert quality.judged(no_documents, keep=("doc_id",)).count() == 0
    assert quality.passing(no_documents).count() == 0
