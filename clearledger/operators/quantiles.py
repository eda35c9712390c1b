"""Exact percentiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearledger.operators.scans import PLACE, scanned
from clearledger.operators.typing import column


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float]) -> DataFrame:
    """``keys, fraction, n, percentile``: the continuous percentiles of ``value``, as a double, in each group.

    Between two neighbouring values it is interpolated. The values are dealt to ranges and numbered along their order, and only the two
    rows at a percentile's place are looked up, so no group's values are gathered: a group may be all rows and all its
    values different. NULL values don't count, NaN is the largest; a group without values gives no row. NULL keys form a group.
    """
    if any(not 0 <= f <= 1 for f in fractions):
        raise ValueError("Fractions lie between 0 and 1")
    named = [column(k) for k in keys]
    rows = df.select(*named, column(value).cast("double").alias("__value")).where("__value IS NOT NULL")
    placed = scanned(rows, keys, ["__value"])
    wanted = F.array(*[F.lit(float(f)) for f in dict.fromkeys(fractions)])
    sizes = placed.groupBy(*named).agg(F.max(PLACE).alias("n")).withColumn("fraction", F.explode(wanted))
    sizes = sizes.withColumn("at", F.col("fraction") * (F.col("n") - 1))
    low, high = F.floor("at"), F.ceil("at")
    ends = F.array(F.struct((low + 1).alias("place"), F.lit(True).alias("low")), F.struct((high + 1).alias("place"), F.lit(False).alias("low")))
    picks = sizes.select(*(k.alias(f"__key_{i}") for i, k in enumerate(named)), "fraction", "n", "at", F.inline(ends))
    same = [k.eqNullSafe(F.col(f"__key_{i}")) for i, k in enumerate(named)]
    found = placed.join(picks, reduce(and_, same, F.col(PLACE) == F.col("place")))
    below = F.max(F.when(F.col("low"), F.col("__value")))
    above = F.max(F.when(~F.col("low"), F.col("__value")))
    between = F.max(F.col("at") - F.floor("at"))
    exact = F.when(between == 0, below).otherwise(below + (above - below) * between)
    return found.groupBy(*named, "fraction", "n").agg(exact.alias("percentile"))
