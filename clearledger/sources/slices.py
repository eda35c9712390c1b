"""Catalog tables that are updated by rewriting only the files that hold changed rows.

Such a table is partitioned by ``slice``, a number that each writing task gives its file. A new version of the table takes over
the slices without changes where they are and points to rewritten ones for the others. The versions change in one
exchange of names, as with tables that are replaced as a whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clearledger.sources.tables import Staged, exchange, literal, quoted

SLICE = "slice"
# Partitions declared in one statement.
DECLARED = 500


@dataclass(frozen=True)
class Updated:
    """What an update met: changed rows, and slices rewritten and taken over."""

    table: str
    n_changed: int
    n_rewritten: int
    n_kept: int


def _write(df: DataFrame, root: str, table: str) -> tuple[str, int]:
    location = f"{root.rstrip('/')}/{table}/version-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n_rows")).write.partitionBy(SLICE).parquet(location)
    return location, seen.get["n_rows"]


def _slice_of(folder: str) -> int:
    return int(folder.rstrip("/").rsplit("=", 1)[1])


def _folders(df: DataFrame) -> dict[int, str]:
    """Where the slices of a table are, from the list of files that reading it needs anyway."""
    folders = {file.rsplit("/", 1)[0] for file in df.inputFiles()}
    return {_slice_of(folder): folder for folder in folders}


def slice_folders(spark: SparkSession, database: str, table: str) -> dict[int, str]:
    return _folders(spark.table(quoted(database, table)))


def _publish(
    spark: SparkSession, database: str, root: str, table: str, schema: StructType, folders: Mapping[int, str]
) -> None:
    """Declare a table of these slices and let it take the name's place; readers see the old one until then."""
    name = quoted(database, table)
    exists = spark.catalog.tableExists(name)
    fresh = quoted(database, f"{table}__new_{uuid.uuid4().hex[:8]}") if exists else name
    columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema if f.name != SLICE)
    spark.sql(
        f"CREATE TABLE {fresh} ({columns}, {SLICE} INT) USING parquet PARTITIONED BY ({SLICE}) "
        f"LOCATION {literal(f'{root.rstrip('/')}/{table}/declared-{uuid.uuid4().hex}')}"
    )
    places = sorted(folders.items())
    try:
        for begin in range(0, len(places), DECLARED):
            parts = " ".join(f"PARTITION ({SLICE}={n}) LOCATION {literal(f)}" for n, f in places[begin : begin + DECLARED])
            spark.sql(f"ALTER TABLE {fresh} ADD {parts}")
    except Exception:
        spark.sql(f"DROP TABLE {fresh}")
        raise
    if exists:
        exchange(spark, database, table, fresh)
    spark.catalog.refreshTable(name)


def refresh_sliced_table(df: DataFrame, database: str, root: str, table: str) -> Staged:
    """Replace ``database.table`` by ``df`` as a table of slices; runs the write.

    No shuffle: every task writes its own slice. Rows that are changed together are best dealt to the same
    tasks, as by a range of their key.
    """
    spark = df.sparkSession
    if SLICE in df.columns:
        raise ValueError(f"The table has a column named {SLICE}")
    location, n_rows = _write(df.withColumn(SLICE, F.spark_partition_id()), root, table)
    schema = df.withColumn(SLICE, F.lit(0)).schema
    folders = _folders(spark.read.parquet(location)) if n_rows else {}
    _publish(spark, database, root, table, schema, folders)
    return Staged(table, location, n_rows)


def _rewrite(
    spark: SparkSession, database: str, root: str, table: str, hit: DataFrame, made: Callable[[DataFrame], DataFrame]
) -> Updated:
    """Rewrite the slices of ``hit`` (``slice, n``, a row per slice) by ``made`` and publish them with the others."""
    current = spark.table(quoted(database, table))
    folders = _folders(current)
    changed = {r[SLICE]: r["n"] for r in hit.collect()}  # as many as there are files to rewrite
    if changed:
        rows = current.where(F.col(SLICE).isin(sorted(changed)))
        location, n_rows = _write(made(rows).select(*current.columns), root, table)
        before = {n: f for n, f in folders.items() if n not in changed}
        after = _folders(spark.read.parquet(location)) if n_rows else {}
        _publish(spark, database, root, table, current.schema, before | after)
    return Updated(table, sum(changed.values()), len(changed), len(folders) - len(changed))


def update_rows(
    spark: SparkSession, database: str, root: str, table: str, changed: Column, columns: Mapping[str, Column]
) -> Updated:
    """Set ``columns`` in the rows where ``changed`` is true, rewriting the slices that hold one.

    The first pass reads the columns of ``changed`` alone, the second only slices with changed rows. Without any, nothing is written.
    """
    holds = F.coalesce(changed, F.lit(False))
    current = spark.table(quoted(database, table))
    hit = current.where(holds).groupBy(SLICE).agg(F.count(F.lit(1)).alias("n"))
    kinds = dict(current.dtypes)
    made = {n: F.when(holds, c).otherwise(F.col(f"`{n}`")).cast(kinds[n]) for n, c in columns.items()}
    return _rewrite(spark, database, root, table, hit, lambda rows: rows.withColumns(made))


def update_by_key(
    spark: SparkSession, database: str, root: str, table: str, updates: DataFrame, keys: Sequence[str]
) -> Updated:
    """Set the other columns of ``updates`` in the rows with its keys, rewriting the slices that hold one.

    Keys that the table lacks are passed over, as are NULL keys; a key given twice is an error.
    """
    by = [F.col(f"`{k}`") for k in keys]
    given = updates.dropna(subset=list(keys))
    if not given.groupBy(*by).count().where("count > 1").isEmpty():
        raise ValueError("An update names a key twice")
    current = spark.table(quoted(database, table))
    kinds = dict(current.dtypes)
    found = current.select(*by, SLICE).join(given.select(*by), list(keys), "left_semi")
    hit = found.groupBy(SLICE).agg(F.count(F.lit(1)).alias("n"))
    others = [c for c in updates.columns if c not in keys]
    names = {c: f"__new_{i}" for i, c in enumerate(others)}
    told = given.select(*by, *(F.col(f"`{c}`").cast(kinds[c]).alias(n) for c, n in names.items()), F.lit(True).alias("__told"))

    def made(rows: DataFrame) -> DataFrame:
        joined = rows.join(told, list(keys), "left")
        return joined.withColumns({c: F.when(F.col("__told"), F.col(n)).otherwise(F.col(f"`{c}`")) for c, n in names.items()})

    return _rewrite(spark, database, root, table, hit, made)


def drop_old_slices(spark: SparkSession, database: str, root: str, table: str) -> int:
    """Remove what lies below ``root`` and is no slice of the published version; returns how many folders.

    Readers that still use an older version fail from then on.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    used = {path(folder).toUri().getPath() for folder in slice_folders(spark, database, table).values()}
    top = path(f"{root.rstrip('/')}/{table}")
    files = top.getFileSystem(conf)
    removed = 0
    for version in files.listStatus(top):
        inside = [s.getPath() for s in files.listStatus(version.getPath())] if version.isDirectory() else []
        kept = [p for p in inside if p.toUri().getPath() in used]
        for old in [p for p in inside if p.toUri().getPath() not in used] if kept else [version.getPath()]:
            files.delete(old, True)
            removed += 1
    return removed
