"""Exact percentiles against DuckDB and Spark's own."""

from __future__ import annotations

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from clearledger.operators.quantiles import exact_percentiles

FRACTIONS = (0, 0.01, 0.25, 0.5, 0.9, 0.999, 1)


@pytest.mark.parametrize("ranges", [3, 31])
def test_one_group_of_different_values(spark, ranges):
    pick = random.Random(ranges)
    values = [(1, pick.random() * 10 ** pick.randrange(6)) for _ in range(5001)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact_percentiles(spark.createDataFrame(values, "k int, v double"), ["k"], "v", FRACTIONS).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    with duckdb.connect() as db:
        db.sql("CREATE TABLE t (k INTEGER, v DOUBLE)")
        db.executemany("INSERT INTO t VALUES (?, ?)", values)
        want = [db.sql(f"SELECT quantile_cont(v, {f}) FROM t").fetchall()[0][0] for f in FRACTIONS]
    assert {r["n"] for r in got} == {5001}
    assert [r["percentile"] for r in sorted(got, key=lambda r: r["fraction"])] == pytest.approx(want, rel=1e-12)


def test_groups_equal_the_plain_aggregate(spark):
    """Ties, a group of a third of all rows, NULL keys and values, a group of one and one of none."""
    pick = random.Random(9)
    rows = [("hot" if i % 3 == 0 else pick.choice(("a", "b", None)), pick.choice((None, 1, 2, 2, 5, i))) for i in range(300)]
    rows += [("one", 7), ("none", None)]
    df = spark.createDataFrame(rows, "`a key` string, v long")
    got = {(r["a key"], r["fraction"]): (r["n"], r["percentile"]) for r in exact_percentiles(df, ["a key"], "v", FRACTIONS).collect()}
    plain = df.groupBy("a key").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, FRACTIONS))).alias("p")).collect()
    want = {(r["a key"], f): (r["n"], p) for r in plain if r["n"] for f, p in zip(FRACTIONS, r["p"], strict=True)}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_nan_and_infinity(spark):
    rows = [(1, v) for v in (float("nan"), float("inf"), -float("inf"), 0.0, 3.0)]
    got = exact_percentiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", [0, 0.25, 0.5, 0.75, 1]).collect()
    values = [r["percentile"] for r in sorted(got, key=lambda r: r["fraction"])]
    assert values[:4] == [-math.inf, 0.0, 3.0, math.inf] and math.isnan(values[4])


def test_no_rows_and_bad_fractions(spark):
    df = spark.createDataFrame([], "k int, v double")
    assert exact_percentiles(df, ["k"], "v", [0.5]).collect() == []
    with pytest.raises(ValueError):
        exact_percentiles(df, ["k"], "v", [1.5])
