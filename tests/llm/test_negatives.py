from __future__ import annotations

import numpy as np
import pytest
from comparing import differences
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clearledger.llm import negatives, queries


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 64, 5), (33, 33, 33), (70, 64, 129), (257, 40, 100), (64, 200, 64)])
def test_strassen_is_exact(shape):
    m, k, n = shape
    random = np.random.default_rng(1)
    a, b = random.integers(-(2**20), 2**20, (m, k)), random.integers(-(2**20), 2**20, (k, n))
    assert np.array_equal(negatives.strassen(a, b), a @ b)
    assert np.array_equal(negatives.products(a, b.T), a @ b)


def test_products_pad_and_refuse():
    a, b = np.array([[1, 2, 3]]), np.array([[4], [5]])
    assert negatives.products(a, b).tolist() == [[4, 5]]
    with pytest.raises(OverflowError):
        negatives.products(np.full((1, 4), 2**31), np.full((1, 4), 2**31))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(-5, 5), st.integers(0, 9)), max_size=12), max_size=6))
def test_heaps_keep_the_best(parts):
    """However entries come in parts, each slot keeps the same."""
    heaps, every = negatives.Heaps(4, 3), []
    for at, part in enumerate(parts):
        rows = np.arange(len(part)) + 100 * at
        columns = [np.array(c, np.int64) for c in zip(*part, strict=True)] if part else [np.zeros(0, np.int64)] * 3
        heaps.offer(*columns, rows)
        every += [(s, -v, i, r) for (s, v, i), r in zip(part, rows.tolist(), strict=True)]
    want = [e for s in range(4) for e in sorted(x for x in every if x[0] == s)[:3]]
    got = list(zip(heaps.slot.tolist(), (-heaps.score).tolist(), heaps.id.tolist(), heaps.row.tolist(), strict=True))
    assert got == want
    for s in range(4):
        own = [e for e in want if e[0] == s]
        if len(own) == 3:
            assert (heaps.floor[s], heaps.last[s]) == (-own[-1][1], own[-1][2])


def expected(rows, asks, positives=5, n_negatives=10):
    """Brute force over (id, label, vector) in Python integers."""
    kept = []
    for i, (key, label, vector) in enumerate(rows):
        if key is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        kept.append((i, key, label, [int(np.floor(256 * x)) for x in vector]))
    out = []
    for i, key, label, v in kept:
        if not asks(key):
            continue
        score = {j: sum(x * y for x, y in zip(v, w, strict=False)) for j, _, _, w in kept}
        order = sorted((-score[j], k, j) for j, k, own, _ in kept if own == label and j != i)
        others = sorted((-score[j], k) for j, k, own, _ in kept if own != label)
        for p, k, _ in order[:positives]:
            near = [(-s, n) for s, n in others if 30 * -p <= 100 * -s <= 90 * -p]
            out += [(key, k, rank, n, -p, s) for rank, (s, n) in enumerate(near[:n_negatives], 1)]
    return sorted(out)


def found(df):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[n] for n in names) for r in df.collect())


SCHEMA = "vec_id long, label int, embedding array<float>"


def mined(spark, rows, **options):
    return negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, **options)


def test_query_equals_sql(spark, folder):
    df = queries.QUERIES["op13_hard_negatives"](spark, folder)
    assert differences(df, queries.ORACLES["op13_hard_negatives"], folder) == ""


@pytest.mark.parametrize("cut", [(4096, 512, 2048), (4, 7, 16)])
def test_many_blocks_and_shares(spark, monkeypatch, cut):
    for name, value in zip(("ANCHORS", "TILE", "SHARE"), cut, strict=True):
        monkeypatch.setattr(negatives, name, value)
    random = np.random.default_rng(3)
    # one label and one vector hold a third of all rows
    rows = []
    for i in range(240):
        vector = [0.5] * 12 if i % 3 == 1 else np.round(random.normal(0.1, 0.3, 12), 2).tolist()
        rows.append((i, 0 if i % 3 == 0 else i % 5, vector))
    assert found(mined(spark, rows)) == expected(rows, lambda k: k % 10 == 0)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, i % 2, [1.0, 0.0]) for i in (40, 7, 9, 3, 8, 2, 4, 6)] + [(i, 1, [0.5, 0.0]) for i in (99, 11, 33)]
    got = found(mined(spark, rows))
    assert got == expected(rows, lambda k: k % 10 == 0)
    assert [r[1:4] for r in got if r[1] == 2] == [(2, 1, 11), (2, 2, 33), (2, 3, 99)]


EDGES = [
    (0, 1, [0.5, 0.25]), (0, 1, [0.5, 0.25]), (10, 1, None), (20, None, [1.0, 1.0]), (30, 1, [None, 1.0]),
    (40, 1, [float("nan"), 1.0]), (50, 1, [float("inf"), 1.0]), (None, 1, [0.5, 0.5]), (60, 2, []), (1, 1, [0.75, 0.5, 0.25]),
    (2, 2, [0.25]), (3, 2, [0.3, 0.1]), (4, 1, [-0.5, -0.5]), (70, 3, [1.0, 1.0]), (5, 2, [0.25]), (80, 2, [-1.0, -1.0]),
]


def test_edges(spark):
    df = spark.createDataFrame(EDGES, SCHEMA)
    want = expected(EDGES, lambda k: k % 10 == 0)
    assert found(negatives.mine(df, F.col("vec_id") % 10 == 0)) == want and want
    clashing = df.withColumns({n: F.lit("own") for n in ("row", "id", "vector", "windows", "place", "block", "score")})
    renamed = clashing.withColumnRenamed("vec_id", "a key").withColumnRenamed("label", "class")
    got = negatives.mine(renamed, F.col("a key") % 10 == 0, key="a key", label="class")
    assert found(got) == want
    assert negatives.mine(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.mine(df, F.lit(None).cast("boolean")).count() == 0


def test_text_labels(spark):
    rows = [(i, i % 3, [float(i), 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("label", F.concat(F.lit("l"), F.col("label").cast("string")))
    assert found(negatives.mine(df, F.col("vec_id") % 10 == 0)) == expected(rows, lambda k: k % 10 == 0)
