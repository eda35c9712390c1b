"""Steps that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearledger.session import shared_folder
from clearledger.sources.files import scan_table

__all__ = ["BLANKS", "columns_of", "running_sums", "scan_table", "stored", "words_of"]

# What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a step's rows to the folder all executors share and read them back.

    The lineage ends there: a lost executor costs its running tasks, not the step.
    """
    place = shared_folder(df.sparkSession, purpose)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def columns_of(df: DataFrame, **named: str) -> DataFrame:
    """Only the named columns, under the operator's own names; all others are left out."""
    return df.select(*(df[f"`{source}`"].alias(name) for name, source in named.items()))


def words_of(text: Column) -> Column:
    """The words of a text, runs of anything but blanks; none for a NULL or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def running_sums(lengths: str) -> str:
    """SQL: for each element of an integer array the sum of those before it.

    Sums of blocks of 64 come first, so a long array costs far less than its square.
    """
    return f"""
    transform(array({lengths}), v -> transform(
      array(transform(sequence(0, greatest(size(v) - 1, 0) div 64),
                      b -> aggregate(slice(v, b * 64 + 1, 64), 0L, (a, x) -> a + x))),
      blocks -> transform(
        array(transform(sequence(0, size(blocks) - 1),
                        b -> aggregate(slice(blocks, 1, b), 0L, (a, x) -> a + x))),
        begins -> transform(v, (x, i) -> get(begins, i div 64)
                    + aggregate(slice(v, (i div 64) * 64 + 1, i % 64), 0L, (a, y) -> a + y)))[0])[0])[0]
    """
