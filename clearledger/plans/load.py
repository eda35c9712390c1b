"""The load job: scan, type, clean, mask, write, count."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from clearledger.operators.counts import table_counts
from clearledger.operators.masking import apply_policy, cell_metrics, changes, holds_pii, masked_columns
from clearledger.operators.typing import apply_types, reject_metrics, resolve_types
from clearledger.sources.files import scan
from clearledger.sources.slices import Updated, update_rows
from clearledger.sources.small import small_table
from clearledger.sources.tables import ensure_database, quoted, refresh_table
from clearledger.specs import MANIFEST, MASK_POLICIES, MaskPolicy, TableSpec


@dataclass(frozen=True)
class Loaded:
    """What one load wrote: rows, unreadable values, and cells the mask met."""

    table: str
    n_written: int
    n_rejected: int
    n_visited: int
    n_masked: int


def _observed(df: DataFrame, metrics: Mapping[str, Column]) -> tuple[DataFrame, Observation | None]:
    if not metrics:
        return df, None
    seen = Observation()
    return df.observe(seen, *[c.alias(name) for name, c in metrics.items()]), seen


def _total(seen: Observation | None, prefix: str = "") -> int:
    return sum(n for name, n in seen.get.items() if name.startswith(prefix)) if seen else 0


def _mask_metrics(policy: MaskPolicy) -> dict[str, Column]:
    pairs = cell_metrics(policy).items()
    visited = {f"visited {n}": v for n, (v, _) in pairs}
    return visited | {f"masked {n}": m for n, (_, m) in pairs}


def load_table(
    spark: SparkSession,
    spec: TableSpec,
    source_folder: str,
    database: str,
    root: str,
    policy: MaskPolicy | None = None,
) -> Loaded:
    """Type, clean, mask and replace one table.

    Masking is part of the projection in front of the write, so unmasked
    values never reach the table. All counts are taken while writing.
    """
    raw = scan(spark, source_folder, spec.source or f"{spec.table}.parquet")
    types = resolve_types(raw, spec)
    counted, rejects = _observed(raw, reject_metrics(raw, spec, types))
    frame, cells = apply_types(counted, spec, types), None
    if policy:
        frame, cells = _observed(frame, _mask_metrics(policy))
        frame = apply_policy(frame, policy)
    staged = refresh_table(frame, database, root, spec.table)
    return Loaded(
        spec.table,
        staged.n_rows,
        _total(rejects),
        _total(cells, "visited "),
        _total(cells, "masked "),
    )


LOADED_FIELDS = {
    "table_name": "string",
    "n_written": "bigint",
    "n_rejected": "bigint",
    "n_visited": "bigint",
    "n_masked": "bigint",
}


def load_tables(
    spark: SparkSession,
    source_folder: str,
    database: str,
    root: str,
    manifest: Sequence[TableSpec] = MANIFEST,
    policies: Mapping[str, MaskPolicy] = MASK_POLICIES,
    at_once: int = 4,
) -> DataFrame:
    """Load every table of the manifest, ``at_once`` at a time, and reconcile the counts.

    Returns the counts of ``Loaded`` per table, with ``n_rows`` and
    ``n_columns`` of the published table and whether it is ``complete``.
    """
    ensure_database(spark, database)
    with ThreadPoolExecutor(at_once) as pool:
        loads = [
            pool.submit(load_table, spark, s, source_folder, database, root, policies.get(s.table))
            for s in manifest
        ]
        loaded = [astuple(load.result()) for load in loads]
    stored = {s.table: spark.table(quoted(database, s.table)) for s in manifest}
    return (
        table_counts(stored)
        .join(small_table(spark, LOADED_FIELDS, loaded), "table_name")
        .withColumn("complete", F.col("n_rows") == F.col("n_written"))
    )


@dataclass(frozen=True)
class Masked:
    """What masking a stored table met: rows, rows with a value, and cells."""

    table: str
    n_rows: int
    n_with_pii: int
    n_visited: int
    n_masked: int


def mask_stored_table(
    spark: SparkSession, database: str, table: str, root: str, policy: MaskPolicy
) -> Masked:
    """Replace a table that was loaded unmasked by its masked version.

    One pass that also takes the counts. The unmasked version stays on disk
    until ``drop_old_versions`` removes it.
    """
    metrics = _mask_metrics(policy) | {"held": F.count_if(holds_pii(policy))}
    stored, cells = _observed(spark.table(quoted(database, table)), metrics)
    staged = refresh_table(apply_policy(stored, policy), database, root, table)
    return Masked(
        table,
        staged.n_rows,
        _total(cells, "held"),
        _total(cells, "visited "),
        _total(cells, "masked "),
    )


def mask_changed_rows(
    spark: SparkSession, database: str, table: str, root: str, policy: MaskPolicy
) -> Updated:
    """Mask the rows of a table of slices that have something left to mask, rewriting the slices that hold one.

    A table already masked is read once and not written; after new rows or updates only their slices are.
    """
    return update_rows(spark, database, root, table, changes(policy), masked_columns(policy))
