"""Work along the order of a key's rows, where one key may hold any share of all rows.

A window over a key is one task. Here rows are dealt to ranges of (key, order), each range is gone
through on its own, and a table with a row per key and range carries what the earlier
ranges add up to. A key of a third of all rows is as spread as any other.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from clearledger.operators.typing import column
from clearledger.sources.steps import written

PART, SEQ, PLACE, BLOCK = "__scan_part", "__scan_seq", "__scan_place", "__scan_block"
# Rows of a key that one task sees in a framed window, besides those at its borders.
BLOCK_ROWS = 100_000
# Code points of an output row of joined texts; what is longer goes on in further rows.
TEXT_LIMIT = 1 << 20


def dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows in ranges of (keys, order): adds the range's number and a number that grows along the order."""
    by = [column(c) for c in (*keys, *order)]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return written(
        ranged.withColumn(PART, F.spark_partition_id()).withColumn(SEQ, F.monotonically_increasing_id()), "scan"
    )


def join_spans(rows: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with what a table of one row per key and range says of theirs; a NULL key is a key."""
    names = {k: f"__span_{i}" for i, k in enumerate((*keys, PART))}
    other = spans.withColumnsRenamed(names)
    same = reduce(and_, [rows[f"`{k}`"].eqNullSafe(other[n]) for k, n in names.items()])
    return rows.join(other, same).drop(*names.values())


def scanned(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: Mapping[str, Column] | None = None
) -> DataFrame:
    """Adds the row's place within its key, from 1, and running sums of ``totals`` up to and with the row."""
    totals = totals or {}
    rows = dealt(df.withColumns(dict(totals)), keys, order)
    named = [column(k) for k in keys]
    offsets = {name: f"__scan_before_{i}" for i, name in enumerate(totals)}
    spans = rows.groupBy(*named, PART).agg(
        F.min(SEQ).alias("__scan_first"), F.count(F.lit(1)).alias("__scan_n"),
        *(F.sum(column(name)).alias(offset) for name, offset in offsets.items()),
    )
    earlier = Window.partitionBy(*named).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        *named, PART, "__scan_first",
        *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("__scan_n", *offsets.values())),
    )
    within = Window.partitionBy(*named, PART).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0)
    placed = join_spans(rows, spans, keys).withColumns(
        {
            PLACE: F.col(SEQ) - F.col("__scan_first") + F.col("__scan_n") + 1,
            **{name: F.col(offset) + F.coalesce(F.sum(column(name)).over(within), F.lit(0)) for name, offset in offsets.items()},
        }
    )
    return placed.drop(PART, SEQ, "__scan_first", "__scan_n", *offsets.values())


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: Mapping[str, Column]) -> DataFrame:
    """Adds running sums of integer or decimal columns along each key; ``order`` tells a key's rows apart.

    A NULL adds nothing. NULL keys form one key. Rows with equal ``order`` are taken in any order.
    """
    return scanned(df, keys, order, totals).drop(PLACE)


def framed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Mapping[str, Callable[[WindowSpec], Column]],
    before: int = 0,
    after: int = 0,
    totals: Mapping[str, Column] | None = None,
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Window functions that look at most ``before`` rows back and ``after`` ahead, such as lag, lead or a frame of rows.

    Each column is made from the window given to it, on which it may set its frame. A key's rows are cut into blocks and a block sees the
    rows at the borders of its neighbours, so the result is that of a window over the whole key. ``totals``
    become running sums on the way.
    """
    if max(before, after) > block:
        raise ValueError("A frame must not be longer than a block")
    rows = scanned(df, keys, order, totals)
    at, inside = F.col(PLACE) - 1, F.pmod(F.col(PLACE) - 1, F.lit(block))
    own = F.expr(f"({PLACE} - 1) DIV {block}")
    places = F.array_compact(
        F.array(own, F.when((inside < after) & (at >= block), own - 1), F.when(inside >= block - before, own + 1))
    )
    seen = rows.withColumn("__scan_own", own).withColumn(BLOCK, F.explode(places))
    window = Window.partitionBy(*[column(k) for k in keys], BLOCK).orderBy(PLACE)
    made = seen.withColumns({name: make(window) for name, make in columns.items()})
    return made.where(F.col(BLOCK) == F.col("__scan_own")).drop(BLOCK, "__scan_own", PLACE)


def ordered_texts(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, separator: str = "", limit: int = TEXT_LIMIT
) -> DataFrame:
    """``keys, piece, text``: the texts of each key joined in order.

    A row holds at most ``limit`` code points. A longer text goes on in the next pieces, numbered from 0, which put one after the other
    are the whole; so no key, however large, has to fit a row. A running length places each text in its
    pieces. NULL counts as empty text and gives a separator too. A key of empty texts has one empty piece.
    """
    given = F.coalesce(column(text), F.lit(""))
    rows = df.select(*[column(c) for c in dict.fromkeys((*keys, *order))], given.alias("__text"))
    rows = scanned(rows, keys, order, {"__end": F.length("__text").cast("long")})
    first = F.col(PLACE) == 1
    said = F.when(first, F.col("__text")).otherwise(F.concat(F.lit(separator), F.col("__text")))
    end = F.col("__end") + (F.col(PLACE) - 1) * len(separator)
    rows = rows.select(*[column(k) for k in keys], said.alias("said"), (end - F.length(said)).alias("begin"), first.alias("first"))
    rows = rows.where("said <> '' OR first")
    cut = rows.withColumn(
        "piece", F.explode(F.expr(f"sequence(begin DIV {limit}, greatest(begin + length(said) - 1, begin) DIV {limit})"))
    )
    cut = cut.withColumn("skipped", F.greatest(F.col("piece") * limit - F.col("begin"), F.lit(0)).cast("int"))
    room = (F.col("piece") + 1) * limit - F.greatest(F.col("begin"), F.col("piece") * limit)
    part = F.substring(F.col("said"), F.col("skipped") + 1, room.cast("int"))
    listed = F.array_sort(F.collect_list(F.struct("begin", part.alias("part"))))
    return cut.groupBy(*[column(k) for k in keys], "piece").agg(listed.alias("listed")).select(
        *[column(k) for k in keys], "piece", F.array_join(F.transform("listed", lambda x: x["part"]), "").alias("text")
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    ties: Sequence[str] = (),
    tolerance: Column | None = None,
    name: str = "match",
) -> DataFrame:
    """Adds to each left row the latest right row of its key that isn't later, as the struct ``name``.

    Of right rows at the same time the last by ``ties`` counts, NULL being the least. ``tolerance``, an interval or a number, bounds how much
    earlier it may be. A left row without one, or with a NULL key or time, has NULL; all left rows are kept.
    """
    known = reduce(and_, [column(k).isNotNull() for k in keys])
    lefts = F.struct(*[column(c) for c in left.columns])
    rights = F.struct(*[column(c) for c in right.columns])
    left_kind, right_kind = (d.select(F.struct(*[column(c) for c in d.columns])).schema[0].dataType for d in (left, right))
    tie_names = [f"__tie_{i}" for i in range(len(ties))]
    named = [f"__key_{i}" for i in range(len(keys))]
    kinds = dict(right.dtypes)

    def line(df: DataFrame, time: str, side: int, own: Column, other: Column, tied: list[Column]) -> DataFrame:
        return df.where(known & column(time).isNotNull()).select(
            *(column(k).alias(n) for k, n in zip(keys, named, strict=True)), column(time).alias("__time"),
            F.lit(side).alias("__side"), *(t.alias(n) for t, n in zip(tied, tie_names, strict=True)),
            *((own.alias("__left"), other.alias("__right")) if side else (other.alias("__left"), own.alias("__right"))),
        )

    met = line(right, right_time, 0, rights, F.lit(None).cast(left_kind), [column(t) for t in ties]).unionByName(
        line(left, left_time, 1, lefts, F.lit(None).cast(right_kind), [F.lit(None).cast(kinds[t]) for t in ties])
    )
    rows = dealt(met, named, ["__time", "__side", *tie_names])
    within = Window.partitionBy(*named, PART).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*named).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max_by(F.col("__right"), F.when(F.col("__right").isNotNull(), F.col(SEQ)))
    spans = rows.groupBy(*named, PART).agg(last.alias("__closing"))
    spans = spans.select(*named, PART, F.last("__closing", ignorenulls=True).over(earlier).alias("__carried"))
    found = join_spans(rows.withColumn("__latest", F.last("__right", ignorenulls=True).over(within)), spans, named)
    match = F.coalesce("__latest", "__carried")
    if tolerance is not None:
        match = F.when(match[right_time] >= F.col("__time") - tolerance, match)
    matched = found.where("__side = 1").select("__left.*", match.alias(name))
    alone = left.where(~(known & column(left_time).isNotNull())).withColumn(name, F.lit(None).cast(right_kind))
    return matched.unionByName(alone)
