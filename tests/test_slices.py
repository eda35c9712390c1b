"""Updates that rewrite only the files that hold changed rows."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from clearledger.operators.masking import apply_policy
from clearledger.plans.load import mask_changed_rows
from clearledger.sources import slices
from clearledger.sources.slices import (
    drop_old_slices,
    refresh_sliced_table,
    slice_folders,
    update_by_key,
    update_rows,
)
from clearledger.sources.tables import ensure_database, quoted
from clearledger.specs import MaskPolicy

DATABASE = "sliced"


@pytest.fixture
def root(spark, tmp_path):
    ensure_database(spark, DATABASE, str(tmp_path / "db"))
    yield str(tmp_path / "tables")
    spark.sql(f"DROP DATABASE {DATABASE} CASCADE")


def numbers(spark, n=100):
    rows = spark.range(n).select("id", (F.col("id") * 10).alias("v"), F.concat(F.lit("t"), "id").alias("a b"))
    return rows.repartitionByRange(8, "id")


def stored(spark, name):
    return sorted(tuple(r) for r in spark.table(quoted(DATABASE, name)).select("id", "v", "a b").collect())


def files(spark, name):
    """Each file of the table with the time it was written."""
    paths = [f.removeprefix("file:").replace("///", "/") for f in spark.table(quoted(DATABASE, name)).inputFiles()]
    return {p: os.stat(p).st_mtime_ns for p in paths}


def test_untouched_files_stay(spark, root):
    assert refresh_sliced_table(numbers(spark), DATABASE, root, "n").n_rows == 100
    before = files(spark, "n")
    done = update_rows(spark, DATABASE, root, "n", F.col("id").between(40, 42), {"v": F.col("v") + 1, "a b": F.lit(None)})
    assert (done.n_changed, done.n_rewritten, done.n_kept) == (3, 1, 7)
    after = files(spark, "n")
    kept = before.keys() & after.keys()
    assert len(before) == 8 and len(kept) == 7 and {p: before[p] for p in kept} == {p: after[p] for p in kept}
    want = [(i, i * 10 + (40 <= i <= 42), None if 40 <= i <= 42 else f"t{i}") for i in range(100)]
    assert stored(spark, "n") == want


def test_nothing_to_change_writes_nothing(spark, root):
    refresh_sliced_table(numbers(spark), DATABASE, root, "n")
    before, there = files(spark, "n"), sorted(os.listdir(f"{root}/n"))
    done = update_rows(spark, DATABASE, root, "n", F.col("a b").isNull() & F.lit(None), {"v": F.lit(0)})
    assert (done.n_changed, done.n_rewritten, done.n_kept) == (0, 0, 8)
    assert files(spark, "n") == before and sorted(os.listdir(f"{root}/n")) == there


def test_updates_by_key(spark, root):
    refresh_sliced_table(numbers(spark), DATABASE, root, "n")
    given = spark.createDataFrame([(3, 7), (98, None), (500, 1), (None, 9)], "id long, v int")
    done = update_by_key(spark, DATABASE, root, "n", given, ["id"])
    assert (done.n_changed, done.n_rewritten, done.n_kept) == (2, 2, 6)
    changed = {3: 7, 98: None}
    assert stored(spark, "n") == [(i, changed.get(i, i * 10), f"t{i}") for i in range(100)]
    assert dict(spark.table(quoted(DATABASE, "n")).dtypes)["v"] == "bigint"
    with pytest.raises(ValueError):
        update_by_key(spark, DATABASE, root, "n", given.unionByName(given), ["id"])
    assert stored(spark, "n")[3] == (3, 7, "t3")


def test_updates_of_a_key_that_many_rows_have(spark, root):
    rows = numbers(spark, 60).withColumn("id", F.col("id") % 3)
    refresh_sliced_table(rows, DATABASE, root, "n")
    done = update_by_key(spark, DATABASE, root, "n", spark.createDataFrame([(1, 5)], "id long, v long"), ["id"])
    assert done.n_changed == 20
    assert [r[1] for r in stored(spark, "n") if r[0] == 1] == [5] * 20 and len(stored(spark, "n")) == 60


def test_a_failed_update_leaves_the_table(spark, root, monkeypatch):
    refresh_sliced_table(numbers(spark), DATABASE, root, "n")
    before = stored(spark, "n")

    def broken(*_):
        raise RuntimeError("no exchange")

    monkeypatch.setattr(slices, "exchange", broken)
    with pytest.raises(RuntimeError):
        update_rows(spark, DATABASE, root, "n", F.lit(True), {"v": F.lit(0)})
    assert stored(spark, "n") == before


def test_old_slices_go(spark, root):
    refresh_sliced_table(numbers(spark), DATABASE, root, "n")
    update_rows(spark, DATABASE, root, "n", F.col("id") < 20, {"v": F.lit(-1)})
    update_rows(spark, DATABASE, root, "n", F.col("id") < 2, {"v": F.lit(-2)})
    want = stored(spark, "n")
    assert drop_old_slices(spark, DATABASE, root, "n") > 0
    spark.catalog.refreshTable(quoted(DATABASE, "n"))
    assert stored(spark, "n") == want
    left = {str(p.parent) for p in Path(root).rglob("*.parquet")}
    assert left == {f.removeprefix("file:").replace("///", "/") for f in slice_folders(spark, DATABASE, "n").values()}


def test_whole_refresh_and_empty_tables(spark, root):
    refresh_sliced_table(numbers(spark), DATABASE, root, "n")
    refresh_sliced_table(numbers(spark, 5), DATABASE, root, "n")
    assert len(stored(spark, "n")) == 5
    refresh_sliced_table(numbers(spark).where("false"), DATABASE, root, "n")
    assert stored(spark, "n") == []
    assert update_rows(spark, DATABASE, root, "n", F.lit(True), {"v": F.lit(0)}).n_changed == 0
    with pytest.raises(ValueError):
        refresh_sliced_table(numbers(spark).withColumn("slice", F.lit(1)), DATABASE, root, "n")


def test_masking_only_what_is_left(spark, root):
    policy = MaskPolicy(phones=("phone",), redacted=("home",))
    rows = spark.range(40).select(
        "id", F.when(F.col("id") % 4 > 0, F.lpad(F.col("id").cast("string"), 8, "9")).alias("phone"),
        F.when(F.col("id") % 5 > 0, "a street").alias("home"),
    )
    refresh_sliced_table(rows.repartitionByRange(4, "id"), DATABASE, root, "p")
    done = mask_changed_rows(spark, DATABASE, "p", root, policy)
    assert done.n_rewritten == 4
    masked = spark.table(quoted(DATABASE, "p")).drop("slice")
    assert sorted(map(repr, masked.collect())) == sorted(map(repr, apply_policy(rows, policy).collect()))
    again = mask_changed_rows(spark, DATABASE, "p", root, policy)
    assert (again.n_changed, again.n_rewritten) == (0, 0)
    update_by_key(spark, DATABASE, root, "p", spark.createDataFrame([(7, "91234567")], "id long, phone string"), ["id"])
    last = mask_changed_rows(spark, DATABASE, "p", root, policy)
    assert (last.n_changed, last.n_rewritten, last.n_kept) == (1, 1, 3)
