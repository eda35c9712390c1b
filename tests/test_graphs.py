"""Reachability against a breadth-first search."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from clearledger.operators import graphs


def walked(edges, starts):
    out = []
    for start in starts:
        seen, level, steps = {}, {start}, 0
        while level:
            steps += 1
            level = {b for a, b in edges if a in level} - seen.keys()
            seen |= dict.fromkeys(level, steps)
        out += [(start, node, n) for node, n in seen.items()]
    return sorted(out)


def found(df):
    return sorted((r["start"], r["node"], r["steps"]) for r in df.collect())


def a_graph(seed):
    """A hub, cycles, a long chain, a loop at a node, repeated edges and ends that are missing."""
    pick = random.Random(seed)
    edges = [(0, i) for i in range(1, 25)] + [(i, 0) for i in range(20, 30)] + [(100 + i, 101 + i) for i in range(12)]
    return edges + [(pick.randrange(30), pick.randrange(40)) for _ in range(25)] + [(7, 7), (112, 100), (0, 1), (0, 1)]


@pytest.mark.parametrize("parts", [1, 8])
def test_closure_equals_a_search(spark, monkeypatch, parts):
    monkeypatch.setattr(graphs, "PARTS", parts)
    edges = a_graph(parts)
    df = spark.createDataFrame([*edges, (None, 3), (3, None)], "a long, b long")
    nodes = {a for a, _ in edges}
    assert found(graphs.reachable(df, "a", "b")) == walked(edges, nodes)
    assert found(graphs.reachable(df, "a", "b", F.col("a") == 100)) == walked(edges, [100])


def test_no_edges(spark):
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    assert graphs.reachable(df, "a", "b", F.lit(False)).collect() == []
    assert found(graphs.reachable(df, "a", "b")) == [(1, 2, 1)]
