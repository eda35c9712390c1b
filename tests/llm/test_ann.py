from __future__ import annotations

import math

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from clearledger.llm import ann, queries


def recall(found, rows, asked, k=20):
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for query, vector in asked:
        wanted = brute.nearest(rows, query, vector, k)
        own = sorted(got.get(query, []))
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1))
        assert all(a[2] >= b[2] - 1e-12 for a, b in zip(own, own[1:], strict=False))
        hits += len({i for _, i in wanted} & {i for _, i, _ in own})
        total += len(wanted)
    return hits / total


def test_query_reaches_the_recall(spark, folder):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = queries.QUERIES["op1_forest"](spark, folder).collect()
    asked = [(i, v) for i, v in vectors if i % 20 == 0]
    assert len(got) == 20 * len(asked)
    assert recall(got, vectors, asked) >= 0.9


@pytest.fixture(scope="module")
def clustered():
    pick = np.random.default_rng(6)
    centres = pick.normal(size=(12, 16)) * 2
    rows = [(i, centres[i % 12] + pick.normal(size=16)) for i in range(3000)]
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in rows]
    rows += [(3000 + i, rows[7][1]) for i in range(1500)]  # a third of all rows are copies
    return rows


def test_lower_levels_and_parts(spark, clustered, monkeypatch):
    """A small sample leaves most levels to shared directions; small parts make leaves meet in pieces."""
    monkeypatch.setattr(ann, "CHUNK", 20)
    df = spark.createDataFrame(clustered, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 50 == 0, leaf=64, sample=200).collect()
    asked = [(i, v) for i, v in clustered if i % 50 == 0]
    assert recall(got, clustered, asked) >= 0.9
    copies = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 3050)
    assert [i for _, i in copies] == [7, *range(3000, 3019)]


def test_queue_gives_all_leaves_once(clustered):
    sample = np.array([v for _, v in clustered[:400]])
    forest = ann.grow(sample, 4000, trees=3, leaf=32)
    assert forest.more > 0
    every = forest.nearest_leaves(sample[0], 10**9)
    assert len(every) == len(set(every)) == 3 * 2 ** (forest.depth + forest.more)
    leaves = forest.leaves(sample[:50])
    for row, vector in enumerate(sample[:50]):
        first = forest.nearest_leaves(vector, 3)
        assert {(t, int(leaves[row, t])) for t in range(3)} == set(first)


def test_edges(spark):
    good = [(i, [float(i), 1.0, -float(i % 3)]) for i in range(1, 25)]
    bad = [(40, None), (60, [0.0, 0.0, 0.0]), (80, [1.0, None, 1.0]), (100, [math.nan, 1.0, 1.0]),
           (120, [math.inf, 1.0, 1.0]), (140, [1.0]), (160, []), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(good + good[:5] + bad, "vec_id long, embedding array<double>").withColumn("tree", F.lit(1))
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).collect()
    assert {r["query_id"] for r in got} == {20} and len(got) == 20
    assert recall(got, good, [(20, good[19][1])]) == 1
    assert got[0].asDict().keys() == {"query_id", "rank", "vec_id", "score"}
    few = ann.nearest(df.where("vec_id IN (20, 3)"), F.col("vec_id") % 20 == 0).collect()
    assert [(r["query_id"], r["vec_id"], r["rank"]) for r in few] == [(20, 3, 1)]
    assert ann.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df, F.lit(False)).count() == 0


@pytest.mark.parametrize("leaf", [512, 8])
def test_ties_of_different_vectors_go_to_the_smaller_key(spark, leaf):
    """60 different vectors are as near as each other; their keys are in no order."""
    pick = np.random.default_rng(8)
    others = pick.normal(size=(60, 6))
    others /= np.linalg.norm(others, axis=1, keepdims=True)
    rows = [(20, [1.0, *[0.0] * 6])]
    rows += [(101 + (i * 37) % 60, [0.5, *v]) for i, v in enumerate(others.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got = ann.nearest(df, F.col("vec_id") == 20, leaf=leaf).collect()
    assert all(r["score"] == 0.5 for r in got) and len(got) == 20
    if leaf == 512:  # one leaf holds all of them
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(101, 121))


def test_queries_whose_first_leaves_are_empty_keep_the_others(spark, monkeypatch):
    """With a leaf for each vector or none, few of which are looked at first."""
    monkeypatch.setattr(ann, "NEAREST", 1)
    rows = [(i, [1.0 + i % 2, float(i), -float(i)]) for i in range(1, 41)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, leaf=1, sample=8).collect()
    assert recall(got, rows, [(i, v) for i, v in rows if i % 20 == 0]) >= 0.7  # leaves of one vector are looked at by far too few
