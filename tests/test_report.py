"""The report on twelve known months."""

from __future__ import annotations

import datetime as dt
import math
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clearledger.functions import numbers
from clearledger.operators import report as R

# month, total, first, repeat, other, and how shares and ratio are shown
MONTHS = [
    (1, 1637, 529, 1104, 4, "32.3%", "67.4%", "1 : 2.1"),
    (2, 1450, 503, 944, 3, "34.7%", "65.1%", "1 : 1.9"),
    (3, 1266, 409, 851, 6, "32.3%", "67.2%", "1 : 2.1"),
    (4, 1688, 592, 1093, 3, "35.1%", "64.8%", "1 : 1.8"),
    (5, 1401, 485, 912, 4, "34.6%", "65.1%", "1 : 1.9"),
    (6, 1089, 381, 705, 3, "35.0%", "64.7%", "1 : 1.9"),
    (7, 1717, 618, 1098, 1, "36.0%", "63.9%", "1 : 1.8"),
    (8, 1534, 579, 951, 4, "37.7%", "62.0%", "1 : 1.6"),
    (9, 1812, 647, 1161, 4, "35.7%", "64.1%", "1 : 1.8"),
    (10, 1649, 594, 1053, 2, "36.0%", "63.9%", "1 : 1.8"),
    (11, 1547, 531, 1015, 1, "34.3%", "65.6%", "1 : 1.9"),
    (12, 1508, 492, 1015, 1, "32.6%", "67.3%", "1 : 2.1"),
]


@pytest.fixture(scope="module")
def visits(spark):
    """One row per visit, so that the counts have to be found again."""
    months = spark.createDataFrame([m[:5] for m in MONTHS], "m int, total int, fv int, rv int, other int")
    kinds = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.col(k).alias("n"))
            for k in ("fv", "rv", "other")
        ]
    )
    return (
        months.select("m", F.inline(kinds))
        .select("m", "kind", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
        .select(F.expr("make_timestamp_ntz(2025, m, 1 + i % 28, 9, 0, 0)").alias("at"), "kind")
    )


@pytest.fixture(scope="module")
def trend(visits):
    return R.monthly_trend(
        visits, F.col("at"), first=F.col("kind") == "fv", repeat=F.col("kind") == "rv"
    ).cache()


def test_counts_and_shares(trend):
    rows = R.with_shares(trend).orderBy("month").collect()
    found = [
        (r.month.month, r.total, r.fv, r.rv, r.other, r.fv_text, r.rv_text, r.ratio_text) for r in rows
    ]
    assert found == MONTHS
    assert rows[0].month_label == "Jan 2025"


def test_totals(trend):
    row = R.totals(trend).first()
    assert (row.total, row.fv, row.rv, row.other) == (18298, 6360, 11902, 36)
    assert row.ratio == pytest.approx(11902 / 6360)
    assert (row.peak_month, row.peak_total) == (dt.datetime(2025, 9, 1), 1812)
    assert (row.low_month, row.low_total) == (dt.datetime(2025, 6, 1), 1089)


def test_key_figures(trend):
    rows = R.kpi_table(trend).orderBy("position").collect()
    assert [(r.label, r.value, r.sub) for r in rows] == [
        ("Total Visits", "18,298", "Jan – Dec 2025"),
        ("First Visits", "6,360", "34.8% of total"),
        ("Repeat Visits", "11,902", "65.0% of total"),
        ("Avg FV:RV Ratio", "1 : 1.9", "Annual average"),
        ("Peak Month", "Sep", "1,812 visits"),
        ("Lowest Month", "Jun", "1,089 visits"),
    ]


def test_series_and_detail(trend):
    series = R.trend_series(trend).groupBy("series").agg(F.count("value").alias("n"), F.sum("value").alias("s"))
    found = {r.series: (r.n, r.s) for r in series.collect()}
    assert found["First Visit (FV)"] == (12, 6360.0)
    assert found["Repeat Visit (RV)"] == (12, 11902.0)
    assert found["FV : RV Ratio"][0] == 12
    january = R.trend_detail(trend).orderBy("month").first()
    assert january.fv_detail == "529 (32.3%)"
    assert january.rv_detail == "1,104 (67.4%)"
    assert january.ratio_detail == "1 : 2.09"
    assert january.total_detail == "1,637"


def trend_of(spark, rows):
    return spark.createDataFrame(
        [(dt.datetime(2025, m, 1), *counts) for m, *counts in rows],
        "month timestamp_ntz, total bigint, fv bigint, rv bigint, other bigint",
    )


def test_ties_take_the_first_month(spark):
    row = R.totals(trend_of(spark, [(3, 5, 5, 0, 0), (1, 5, 5, 0, 0), (2, 5, 5, 0, 0)])).first()
    assert row.peak_month.month == row.low_month.month == 1


def test_nothing_to_divide_by(spark):
    rows = R.with_shares(trend_of(spark, [(1, 2, 2, 0, 0), (2, 2, 0, 2, 0), (3, 1, 0, 0, 1)]))
    first, second, third = rows.orderBy("month").collect()
    assert (first.ratio, first.ratio_text) == (0.0, "—")
    assert (second.ratio, second.ratio_text) == (math.inf, "1 : Infinity")
    assert math.isnan(third.ratio)
    assert third.ratio_text == "—"


def test_numbers_stay_numbers_outside_the_table(spark):
    trend = trend_of(spark, [(1, 2, 2, 0, 0), (2, 2, 0, 2, 0), (3, 1, 0, 0, 1)])
    detail = [r.ratio_detail for r in R.trend_detail(trend).orderBy("month").collect()]
    assert detail == ["1 : 0.00", "1 : Infinity", "1 : NaN"]
    without_repeats = R.kpi_table(trend.where("rv = 0")).where("label = 'Avg FV:RV Ratio'").first()
    assert without_repeats["value"] == "1 : 0.0"


def test_period_over_several_years(spark):
    trend = trend_of(spark, [(2, 5, 5, 0, 0)]).union(
        spark.sql("SELECT TIMESTAMP_NTZ'2026-03-01' AS month, 9L, 4L, 5L, 0L")
    )
    rows = R.kpi_table(trend).orderBy("position").collect()
    assert rows[0]["sub"] == "Feb 2025 – Mar 2026"
    assert rows[4]["value"] == "Mar 2026"


def to_fixed(x: float, digits: int) -> str:
    """Round the exact binary value, ties upwards."""
    return str(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


@settings(max_examples=10, deadline=None)
@given(
    st.lists(
        st.one_of(
            st.floats(0, 1e6, allow_nan=False),
            st.integers(0, 100000).map(lambda i: i / 16),
            st.integers(0, 100000).map(lambda i: i / 1000),
        ),
        min_size=1,
        max_size=100,
    )
)
def test_fixed_decimals(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    shown = df.select(
        "x", *[numbers.fixed_decimals(F.col("x"), d).alias(f"d{d}") for d in (1, 2)]
    ).collect()
    for row in shown:
        assert row.d1 == to_fixed(row.x, 1)
        assert row.d2 == to_fixed(row.x, 2)
