"""Every registered query against its SQL on whole tables."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from comparing import differences, type_differences

import __spark_entry__ as entry_points
from clearledger.plans.registry import ORACLES, QUERIES

# Plan nodes that pair every row with every other, or leave the JVM.
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas")


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert differences(df, ORACLES[name], folder) == ""
    assert type_differences(df, ORACLES[name], folder) == {}


@pytest.mark.parametrize("name", QUERIES)
def test_plan_scales(spark, folder, name):
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        QUERIES[name](spark, folder).explain("formatted")
    plan = shown.getvalue()
    assert [node for node in UNWANTED if node in plan] == []


def test_windows_run_over_aggregates_or_slices(spark, folder):
    """Only top-k and as-of windows may see table rows; both are bounded."""
    bounded = {"sql_topk_per_group", "sql_distinct_on", "sql_asof"}
    for name, query in QUERIES.items():
        shown = io.StringIO()
        with contextlib.redirect_stdout(shown):
            query(spark, folder).explain()
        plan = shown.getvalue()
        if re.search(r"\bWindow \[", plan) and name not in bounded:
            below = plan[plan.index("Window [") :]
            assert "Aggregate(" in below, name


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0
    assert "ratio_text" in df.columns
