"""Joins of intervals that overlap, and of points within intervals, on tables of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearledger.operators.typing import column
from clearledger.sources.steps import written

# Bins of one level are so many times as wide as those of the level below it.
STEP = 8
# Rows of one side of a bin that meet those of the other in one task.
MEETING = 20_000
KEY, LEVEL, BIN, FIRST, ROW, PART, OTHER = (f"__bin_{n}" for n in ("key", "level", "no", "first", "row", "part", "other"))


def _position(value: Column, kind: T.DataType) -> Column:
    """A value on a line of numbers, in the order of the values themselves."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    raise ValueError(f"{kind.simpleString()} values have no place on a line")


def _side(df: DataFrame, on: Sequence[str], start: str, end: str, mark: str) -> DataFrame:
    """The side's rows as structs with the positions of their ends; rows that can't overlap anything are left out."""
    begins, ends = column(start), column(end)
    known = [column(k).isNotNull() for k in on]
    # A NULL start or end is open. An interval is empty if it ends where it begins.
    there = reduce(and_, known, begins.isNull() | ends.isNull() | (begins < ends))
    kinds = df.schema
    return df.where(there).select(
        F.array(*[column(k).cast("string") for k in on]).alias(KEY) if on else F.lit(0).alias(KEY),
        F.struct(*[column(c) for c in df.columns]).alias(mark),
        begins.alias(f"{mark}_start"), ends.alias(f"{mark}_end"),
        _position(begins, kinds[start].dataType).alias("low"), _position(ends, kinds[end].dataType).alias("high"),
    )


def _leveled(rows: DataFrame, width: float, top: int, ends: tuple[float, float]) -> DataFrame:
    """Adds ``own``, the first level whose bins are as wide as the interval; an open end reaches as far as any value does."""
    low, high = F.coalesce("low", F.lit(ends[0])), F.coalesce("high", F.lit(ends[1]))
    low, high = F.least(low, high), F.greatest(low, high)
    ratio = F.greatest((high - low) / width, F.lit(1.0))
    own = F.least(F.ceil(F.log(ratio) / F.log(F.lit(float(STEP)))), F.lit(top)).cast("int")
    return rows.withColumns({"own": own, "low": low, "high": high, ROW: F.monotonically_increasing_id()})


def _dealt(rows: DataFrame, width: float, others: Sequence[int], mark: str) -> DataFrame:
    """Each interval in the bins it touches, on its own level and on the other side's levels above it.

    On a level that wide an interval touches two bins at most (three, where rounding makes its own level too narrow), so a
    long one isn't dealt to many.
    """
    above = F.filter(F.array(*[F.lit(o) for o in others]), lambda o: o > F.col("own"))
    own = F.when(F.col("own") >= min(others, default=0), F.col("own"))
    leveled = rows.withColumn(LEVEL, F.explode(F.array_compact(F.concat(F.array(own), above))))
    scale = F.lit(width) * F.pow(F.lit(float(STEP)), F.col(LEVEL))
    first, last = F.floor(F.col("low") / scale), F.floor(F.col("high") / scale)
    return leveled.withColumn(f"{mark}_{FIRST}", first).withColumn(BIN, F.explode(F.sequence(first, last))).select(
        KEY, LEVEL, BIN, f"{mark}_{FIRST}", F.col("own").alias(f"{mark}_own"), F.col(ROW).alias(f"{mark}_row"),
        mark, f"{mark}_start", f"{mark}_end",
    )


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    on: Sequence[str] = (),
) -> DataFrame:
    """Pairs of rows, as structs ``left`` and ``right``, whose intervals share a point and whose ``on`` columns are equal.

    Intervals hold their start and not their end; a NULL start or end is open, and an interval that doesn't end after it starts holds nothing.
    Both sides' ends are numbers, dates or timestamps. NULLs in ``on`` equal nothing.

    The narrowest bins are as wide as the median interval. Each interval lies in at most two bins of its own level and of each
    wider one, and a pair is made on the first level that holds both, in the first bin they share. Bins of many rows are
    cut into parts, and every two parts of both sides meet in a task of their own. The work of a bin grows
    with its rows of one side times those of the other, most of which do overlap.
    """
    sides = [_side(left, on, *left_span, "left"), _side(right, on, *right_span, "right")]
    positions = sides[0].select("low", "high").unionByName(sides[1].select("low", "high"))
    about = positions.agg(
        F.min(F.least("low", "high")).alias("low"), F.max(F.greatest("low", "high")).alias("high"),
        F.percentile_approx(F.col("high") - F.col("low"), 0.5).alias("median"),
    ).first()
    low, high = (about["low"], about["high"]) if about["low"] is not None else (0.0, 0.0)
    # Wide enough that neither side of a very narrow median makes more levels than a few dozen.
    width = max(about["median"] or 0.0, (high - low) / STEP**12, 1e-9 * max(abs(low), abs(high)), 1e-300)
    top = 0
    while width * STEP**top < high - low:
        top += 1
    leveled = [_leveled(rows, width, top, (low, high)) for rows in sides]
    # A row per level, of which there are a few dozen at most.
    levels = [[r["own"] for r in rows.select("own").distinct().collect()] for rows in leveled]
    lefts = written(_dealt(leveled[0], width, levels[1], "left"), "bins")
    rights = written(_dealt(leveled[1], width, levels[0], "right"), "bins")
    place = [KEY, LEVEL, BIN]

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / MEETING).cast("int").alias(name))

    parts = counts(lefts, "n_left").join(counts(rights, "n_right"), place)
    hot = written(parts.where("n_left > 1 OR n_right > 1"), "hot-bins")

    def split(df: DataFrame, mark: str, own: str, other: str) -> DataFrame:
        """Rows of hot bins with their own part, once for every part of the other side; other rows are parts 0 and 0."""
        cut = df.join(hot, place, "left")
        n_own, n_other = (F.coalesce(c, F.lit(1)) for c in (own, other))
        cut = cut.withColumn(PART, F.pmod(F.xxhash64(f"{mark}_row"), n_own)).drop(own)
        return cut.withColumn(OTHER, F.explode(F.sequence(F.lit(0), (n_other - 1).cast("int")))).drop(other)

    one = split(lefts, "left", "n_left", "n_right")
    two = split(rights, "right", "n_right", "n_left")
    held = [c for c in two.columns if c.startswith("right")]
    two = two.select(*place, F.col(OTHER).alias(PART), F.col(PART).alias(OTHER), *held)
    met = one.join(two, [*place, PART, OTHER])
    inside = (F.coalesce(F.col("left_start") < F.col("right_end"), F.lit(True))
              & F.coalesce(F.col("right_start") < F.col("left_end"), F.lit(True)))
    level = F.col(LEVEL) == F.greatest("left_own", "right_own")
    bin_no = F.col(BIN) == F.greatest(f"left_{FIRST}", f"right_{FIRST}")
    return met.where(level & bin_no & inside).select("left", "right")


def points_within(points: DataFrame, spans: DataFrame, point: str, span: tuple[str, str], on: Sequence[str] = ()) -> DataFrame:
    """Pairs, as structs ``point`` and ``span``, of points and the intervals that hold them.

    As ``overlap_join``, a point being an interval that holds it alone. NULL points are in none.
    """
    kind = points.schema[point].dataType
    begins = column(point)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        after = begins + F.expr("INTERVAL 1 MICROSECOND")
    elif isinstance(kind, T.DateType):
        after = F.date_add(begins, 1)
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        after = begins.cast("decimal(20,0)") + 1
    else:
        raise ValueError("Points are whole numbers, dates or timestamps")
    ended = points.where(begins.isNotNull()).withColumn("__point_end", after)
    found = overlap_join(ended, spans, (point, "__point_end"), span, on)
    return found.select(F.col("left").dropFields("__point_end").alias("point"), F.col("right").alias("span"))
