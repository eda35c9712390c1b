"""Masking policies as projections, with the counts that go with them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearledger.functions import text
from clearledger.operators.typing import column
from clearledger.specs import MaskPolicy


def _cell(name: str) -> Column:
    """A cell as text, so that a number kept as a number is masked too."""
    return column(name).cast("string")


def masked_columns(policy: MaskPolicy) -> dict[str, Column]:
    masked = {}
    for name in policy.escaped_phones:
        value = _cell(name)
        masked[name] = F.when(value == "", value).otherwise(
            text.mask_phone(text.decode_phone(value))
        )
    for name in policy.phones:
        masked[name] = text.mask_phone(text.empty_to_null(_cell(name)))
    for name in policy.redacted:
        masked[name] = text.redact(_cell(name))
    return masked


def apply_policy(df: DataFrame, policy: MaskPolicy) -> DataFrame:
    """Masked table; a projection, so it belongs before the write."""
    return df.withColumns(masked_columns(policy))


def changes(policy: MaskPolicy) -> Column:
    """Whether masking changes any cell of the row."""
    return reduce(or_, [~masked.eqNullSafe(_cell(name)) for name, masked in masked_columns(policy).items()])


def holds_pii(policy: MaskPolicy) -> Column:
    """Whether any column of the policy has a value."""
    return reduce(or_, [column(n).isNotNull() for n in policy.columns])


def coverage(df: DataFrame, policy: MaskPolicy) -> DataFrame:
    """Rows in which any column of the policy has a value, and all rows."""
    return df.agg(
        F.count_if(holds_pii(policy)).alias("rows_with_pii"),
        F.count(F.lit(1)).alias("rows_total"),
    )


def _fits(policy: MaskPolicy) -> dict[str, Column]:
    """Whether a cell that is visited ends up masked."""
    fits = {n: text.is_phone(text.decode_phone(_cell(n))) for n in policy.escaped_phones}
    fits |= {n: text.is_phone(_cell(n)) for n in policy.phones}
    return fits | {n: F.lit(True) for n in policy.redacted}


def cell_metrics(policy: MaskPolicy) -> dict[str, tuple[Column, Column]]:
    """Aggregates over unmasked rows: cells visited and cells masked per column."""
    metrics = {}
    for name, fits in _fits(policy).items():
        visited = _cell(name) != ""
        metrics[name] = (F.count_if(visited), F.count_if(visited & fits))
    return metrics


def mask_metrics(df: DataFrame, policy: MaskPolicy) -> DataFrame:
    """Per column: cells visited, masked, and left readable.

    A phone that does not fit the pattern is visited but stays as it is; those
    are the ``n_residue`` cells. One aggregate over the unmasked table.
    """
    counts, entries = [], []
    for i, (name, (visited, masked)) in enumerate(cell_metrics(policy).items()):
        counts += [visited.alias(f"v{i}"), masked.alias(f"m{i}")]
        entries.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.col(f"v{i}").alias("n_visited"),
                F.col(f"m{i}").alias("n_masked"),
                (F.col(f"v{i}") - F.col(f"m{i}")).alias("n_residue"),
            )
        )
    return df.agg(*counts).select(F.inline(F.array(*entries)))


def masked_sample(
    masked: DataFrame, shown: list[str], not_null: str, order_key: str, rows: int = 3
) -> DataFrame:
    """The first rows that hold a value, to look at after masking."""
    return (
        masked.where(column(not_null).isNotNull())
        .orderBy(column(order_key))
        .limit(rows)
        .select(column(order_key), *[column(n) for n in shown])
    )
