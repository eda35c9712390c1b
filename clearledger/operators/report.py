"""Monthly visits by kind: counts, shares, ratios, extremes and key figures.

``monthly_trend`` is the only step that reads the visits; it aggregates before
its shuffle. Everything after it works on one row per month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearledger.functions import moments, numbers

# Labels of the key figures and of the plotted series.
TOTAL_LABEL = "Total Visits"
FIRST_LABEL = "First Visits"
REPEAT_LABEL = "Repeat Visits"
RATIO_LABEL = "Avg FV:RV Ratio"
PEAK_LABEL = "Peak Month"
LOWEST_LABEL = "Lowest Month"
RATIO_NOTE = "Annual average"
FIRST_SERIES = "First Visit (FV)"
REPEAT_SERIES = "Repeat Visit (RV)"
RATIO_SERIES = "FV : RV Ratio"


def monthly_trend(
    visits: DataFrame, moment: Column, first: Column, repeat: Column, where: Column | None = None
) -> DataFrame:
    """Visits per month: all, first, repeat, and neither."""
    kept = visits if where is None else visits.where(where)
    return (
        kept.groupBy(moments.month_start(moment).alias("month"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(first).alias("fv"),
            F.count_if(repeat & ~first).alias("rv"),
        )
        .withColumn("other", F.col("total") - F.col("fv") - F.col("rv"))
    )


def with_shares(trend: DataFrame) -> DataFrame:
    """Shares in percent and the ratio, as numbers and as shown."""
    fv, rv, total = F.col("fv"), F.col("rv"), F.col("total")
    return trend.withColumns(
        {
            "month_label": moments.month_label(F.col("month")),
            "fv_share": numbers.share(fv, total),
            "rv_share": numbers.share(rv, total),
            "ratio": numbers.ratio(fv, rv),
            "fv_text": numbers.percent_text(fv, total),
            "rv_text": numbers.percent_text(rv, total),
            "ratio_text": numbers.ratio_or_dash(fv, rv),
        }
    )


def _month_number(month: Column) -> Column:
    return F.year(month) * 12 + F.month(month)


def totals(trend: DataFrame) -> DataFrame:
    """One row: sums, ratio of the sums, first peak month and first lowest month."""
    month, total = F.col("month"), F.col("total")
    peak_order = F.struct(total, -_month_number(month))
    low_order = F.struct(total, _month_number(month))
    summed = trend.agg(
        F.sum("total").alias("total"),
        F.sum("fv").alias("fv"),
        F.sum("rv").alias("rv"),
        F.sum("other").alias("other"),
        F.min("month").alias("from_month"),
        F.max("month").alias("to_month"),
        F.max_by(month, peak_order).alias("peak_month"),
        F.max("total").alias("peak_total"),
        F.min_by(month, low_order).alias("low_month"),
        F.min("total").alias("low_total"),
    )
    return summed.withColumn("ratio", numbers.ratio(F.col("fv"), F.col("rv")))


def _period(first: Column, last: Column) -> Column:
    same_year = F.year(first) == F.year(last)
    opening = F.when(same_year, F.date_format(first, "MMM")).otherwise(moments.month_label(first))
    return F.concat(opening, F.lit(" – "), moments.month_label(last))


def _month_name(month: Column, first: Column, last: Column) -> Column:
    """Month alone while the report stays within one year."""
    same_year = F.year(first) == F.year(last)
    return F.when(same_year, F.date_format(month, "MMM")).otherwise(moments.month_label(month))


def kpi_table(trend: DataFrame) -> DataFrame:
    """Six rows of ``position, label, value, sub``."""
    total, fv, rv = F.col("total"), F.col("fv"), F.col("rv")
    bounds = (F.col("from_month"), F.col("to_month"))

    def of_total(part: Column) -> Column:
        return F.concat(numbers.percent_text(part, total), F.lit(" of total"))

    def visits(count: Column) -> Column:
        return F.concat(numbers.thousands(count), F.lit(" visits"))

    figures = [
        (TOTAL_LABEL, numbers.thousands(total), _period(*bounds)),
        (FIRST_LABEL, numbers.thousands(fv), of_total(fv)),
        (REPEAT_LABEL, numbers.thousands(rv), of_total(rv)),
        (RATIO_LABEL, numbers.ratio_text(fv, rv), F.lit(RATIO_NOTE)),
        (PEAK_LABEL, _month_name(F.col("peak_month"), *bounds), visits(F.col("peak_total"))),
        (LOWEST_LABEL, _month_name(F.col("low_month"), *bounds), visits(F.col("low_total"))),
    ]
    rows = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(label).alias("label"),
            value.alias("value"),
            sub.alias("sub"),
        )
        for i, (label, value, sub) in enumerate(figures)
    ]
    return totals(trend).select(F.inline(F.array(*rows)))


def trend_series(trend: DataFrame) -> DataFrame:
    """Long form of the plot: two stacked series and the ratio line."""
    wide = trend.select(
        "month",
        F.col("fv").cast("double").alias(FIRST_SERIES),
        F.col("rv").cast("double").alias(REPEAT_SERIES),
        numbers.ratio(F.col("fv"), F.col("rv")).alias(RATIO_SERIES),
    )
    return wide.unpivot(
        ["month"], [f"`{s}`" for s in (FIRST_SERIES, REPEAT_SERIES, RATIO_SERIES)], "series", "value"
    )


def trend_detail(trend: DataFrame) -> DataFrame:
    """Texts shown for one month: count and share per series, ratio, total."""
    fv, rv, total = F.col("fv"), F.col("rv"), F.col("total")

    def counted(part: Column) -> Column:
        share_text = numbers.percent_text(part, total)
        return F.concat(numbers.thousands(part), F.lit(" ("), share_text, F.lit(")"))

    return trend.select(
        "month",
        counted(fv).alias("fv_detail"),
        counted(rv).alias("rv_detail"),
        numbers.ratio_text(fv, rv, digits=2).alias("ratio_detail"),
        numbers.thousands(total).alias("total_detail"),
    )
