"""Profiles merged from those of files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clearledger.operators import profiles

KINDS = "id long, half double, word string, day date, flag boolean"


def load(spark, place, begin, end):
    rows = spark.range(begin, end).select(
        "id", (F.col("id") / 2).alias("half"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("w"), F.col("id") % 50)).alias("word"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int") % 300).alias("day"), (F.col("id") % 2 == 0).alias("flag"),
    )
    rows.repartition(3).write.mode("append").parquet(place)


def read(spark, place):
    return spark.read.schema(KINDS).parquet(place)


def shown(df):
    return {r["column_name"]: r for r in df.collect()}


@pytest.mark.parametrize("name", ["plain", "with space+%25 and ä"])
def test_only_new_files_are_profiled(spark, tmp_path, name):
    table, place = str(tmp_path / name), str(tmp_path / "profiles")
    load(spark, table, 0, 5000)
    first = shown(profiles.update_profiles(spark, read(spark, table), place))
    assert first["id"]["n_rows"] == 5000
    load(spark, table, 5000, 20_000)
    got = shown(profiles.update_profiles(spark, read(spark, table), place))
    kept = spark.read.parquet(place)
    assert kept.select("file").distinct().count() == 6 and kept.count() == 6 * 5  # no file twice
    assert (got["id"]["n_rows"], got["id"]["n_missing"], got["id"]["least_number"], got["id"]["greatest_number"]) == (20_000, 0, 0, 19_999)
    assert (got["word"]["n_missing"], got["word"]["least_text"], got["word"]["greatest_text"]) == (5000, "w0", "w9")
    assert (got["day"]["least_text"], got["day"]["greatest_text"]) == ("2024-01-01", "2024-10-26")
    assert got["flag"]["n_distinct"] == 2 and got["word"]["least_number"] is None and got["day"]["median"] is None
    for name, exact in (("id", 20_000), ("half", 20_000), ("day", 300)):
        assert abs(got[name]["n_distinct"] - exact) <= 3 * 0.0163 * exact
    for part, fraction in (("first_quartile", 0.25), ("median", 0.5), ("third_quartile", 0.75)):
        assert abs(got["id"][part] / 20_000 - fraction) <= 0.035
    again = shown(profiles.update_profiles(spark, read(spark, table), place))
    # quartiles of merged sketches are drawn anew
    steady = [c for c in again["id"].asDict() if c not in ("first_quartile", "median", "third_quartile")]
    assert {n: [r[c] for c in steady] for n, r in again.items()} == {n: [r[c] for c in steady] for n, r in got.items()}
    assert spark.read.parquet(place).count() == 30


def test_files_that_are_gone_do_not_count(spark, tmp_path):
    table, place = str(tmp_path / "t"), str(tmp_path / "profiles")
    load(spark, table, 0, 300)
    profiles.update_profiles(spark, read(spark, table), place)
    spark.range(10, 20).select("id", *(F.lit(None).cast(k).alias(n) for n, k in (x.split() for x in KINDS.split(", ")[1:]))).write.mode(
        "overwrite"
    ).parquet(table)
    got = shown(profiles.update_profiles(spark, read(spark, table), place))
    assert (got["id"]["n_rows"], got["id"]["least_number"], got["id"]["greatest_number"]) == (10, 10, 19)
    assert got["half"]["n_missing"] == 10 and got["half"]["median"] is None and got["half"]["n_distinct"] == 0


def test_profiles_of_files_equal_those_of_the_table(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    got = shown(profiles.merged(profiles.file_profiles(lines)))
    for name, kind in lines.dtypes:
        exact = lines.agg(F.count_if(F.col(name).isNull()), F.count_distinct(name), F.min(name), F.max(name)).first()
        assert got[name]["n_missing"] == exact[0]
        assert abs(got[name]["n_distinct"] - exact[1]) <= max(1, 3 * 0.0163 * exact[1])
        if kind in ("bigint", "int", "double"):
            assert (got[name]["least_number"], got[name]["greatest_number"]) == (exact[2], exact[3])
