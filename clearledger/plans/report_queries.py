"""Queries on the monthly report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearledger.operators import report as R
from clearledger.plans.registry import query
from clearledger.sources.files import scan_table

# Orders stand in for visits: finished ones only, first or repeat by priority.
FIRST = ("1-URGENT", "2-HIGH")
REPEAT = ("3-MEDIUM", "4-NOT SPECIFIED")

DUCK_TREND = f"""
    SELECT date_trunc('month', o_orderdate) AS month, count(*) AS total,
           count(*) FILTER (WHERE o_orderpriority IN {FIRST}) AS fv,
           count(*) FILTER (WHERE o_orderpriority IN {REPEAT}) AS rv,
           count(*) FILTER (WHERE o_orderpriority NOT IN {FIRST + REPEAT}) AS other
    FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL
"""


def trend(spark: SparkSession, folder: str) -> DataFrame:
    return R.monthly_trend(
        scan_table(spark, folder, "orders"),
        F.col("o_orderdate"),
        first=F.col("o_orderpriority").isin(*FIRST),
        repeat=F.col("o_orderpriority").isin(*REPEAT),
        where=F.col("o_orderstatus") == "F",
    )


@query(f"SELECT CAST(month AS TIMESTAMP) AS month, total, fv, rv, other FROM ({DUCK_TREND})")
def monthly_trend(spark: SparkSession, folder: str) -> DataFrame:
    return trend(spark, folder)


SHOWN_RATIO = """
    '1 : ' || CASE WHEN fv = 0 AND rv = 0 THEN 'NaN' WHEN fv = 0 THEN 'Infinity' ELSE {} END
"""


def _duck_decimals(value: str, digits: int) -> str:
    return f"printf('%.{digits}f', {value} + CASE WHEN ({value} * {2 ** (digits + 1)}) % 2 = 1 THEN 1e-6 ELSE 0 END)"


def _duck_percent(part: str) -> str:
    return _duck_decimals(f"({part} / total) * 100", 1) + " || '%'"


def _duck_ratio(digits: int) -> str:
    return SHOWN_RATIO.format(_duck_decimals("rv / fv", digits))


@query(
    f"""
    SELECT CAST(month AS TIMESTAMP) AS month, strftime(month, '%b %Y') AS month_label,
           round(fv / total * 100, 6) AS fv_share, round(rv / total * 100, 6) AS rv_share,
           round(rv / fv, 6) AS ratio, {_duck_percent('fv')} AS fv_text,
           {_duck_percent('rv')} AS rv_text,
           CASE WHEN rv = 0 THEN '—' ELSE {_duck_ratio(1)} END AS ratio_text
    FROM ({DUCK_TREND})
    """
)
def monthly_shares(spark: SparkSession, folder: str) -> DataFrame:
    shares = R.with_shares(trend(spark, folder))
    rounded = {n: F.round(n, 6) for n in ("fv_share", "rv_share", "ratio")}
    return shares.withColumns(rounded).drop("total", "fv", "rv", "other")


DUCK_TOTALS = f"""
    SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(fv) AS BIGINT) AS fv,
           CAST(sum(rv) AS BIGINT) AS rv, CAST(sum(other) AS BIGINT) AS other,
           CAST(min(month) AS TIMESTAMP) AS from_month, CAST(max(month) AS TIMESTAMP) AS to_month,
           CAST((SELECT month FROM trend ORDER BY total DESC, month LIMIT 1) AS TIMESTAMP) AS peak_month,
           max(total) AS peak_total,
           CAST((SELECT month FROM trend ORDER BY total, month LIMIT 1) AS TIMESTAMP) AS low_month,
           min(total) AS low_total
    FROM trend
"""


@query(
    f"""
    WITH trend AS ({DUCK_TREND}), totals AS ({DUCK_TOTALS})
    SELECT *, round(rv / fv, 6) AS ratio FROM totals
    """
)
def peak_low_month(spark: SparkSession, folder: str) -> DataFrame:
    return R.totals(trend(spark, folder)).withColumn("ratio", F.round("ratio", 6))


@query(
    f"""
    WITH trend AS ({DUCK_TREND}), totals AS ({DUCK_TOTALS})
    SELECT 1 AS position, 'Total Visits' AS label, format('{{:,}}', total) AS value,
           strftime(from_month, '%b %Y') || ' – ' || strftime(to_month, '%b %Y') AS sub
    FROM totals
    UNION ALL SELECT 2, 'First Visits', format('{{:,}}', fv), {_duck_percent('fv')} || ' of total' FROM totals
    UNION ALL SELECT 3, 'Repeat Visits', format('{{:,}}', rv), {_duck_percent('rv')} || ' of total' FROM totals
    UNION ALL SELECT 4, 'Avg FV:RV Ratio', {_duck_ratio(1)}, 'Annual average' FROM totals
    UNION ALL SELECT 5, 'Peak Month', strftime(peak_month, '%b %Y'),
                     format('{{:,}}', peak_total) || ' visits' FROM totals
    UNION ALL SELECT 6, 'Lowest Month', strftime(low_month, '%b %Y'),
                     format('{{:,}}', low_total) || ' visits' FROM totals
    """
)
def kpi_table(spark: SparkSession, folder: str) -> DataFrame:
    return R.kpi_table(trend(spark, folder))


@query(
    f"""
    WITH trend AS ({DUCK_TREND})
    SELECT CAST(month AS TIMESTAMP) AS month, 'First Visit (FV)' AS series, CAST(fv AS DOUBLE) AS value
    FROM trend
    UNION ALL SELECT CAST(month AS TIMESTAMP), 'Repeat Visit (RV)', CAST(rv AS DOUBLE) FROM trend
    UNION ALL SELECT CAST(month AS TIMESTAMP), 'FV : RV Ratio', round(rv / fv, 6) FROM trend
    """
)
def trend_long(spark: SparkSession, folder: str) -> DataFrame:
    return R.trend_series(trend(spark, folder)).withColumn("value", F.round("value", 6))


@query(
    f"""
    SELECT CAST(month AS TIMESTAMP) AS month,
           format('{{:,}}', fv) || ' (' || {_duck_percent('fv')} || ')' AS fv_detail,
           format('{{:,}}', rv) || ' (' || {_duck_percent('rv')} || ')' AS rv_detail,
           {_duck_ratio(2)} AS ratio_detail, format('{{:,}}', total) AS total_detail
    FROM ({DUCK_TREND})
    """
)
def trend_detail(spark: SparkSession, folder: str) -> DataFrame:
    return R.trend_detail(trend(spark, folder))
