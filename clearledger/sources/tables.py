"""Catalog tables that are replaced as a whole at each load."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def quoted(*parts: str) -> str:
    return ".".join(f"`{p.replace('`', '``')}`" for p in parts)


def literal(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def ensure_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    where = f" LOCATION {literal(location)}" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(database)}{where}")


@dataclass(frozen=True)
class Staged:
    table: str
    location: str
    n_rows: int


def stage(df: DataFrame, root: str, table: str) -> Staged:
    """Write a new version next to the current one, counting rows on the way.

    No shuffle: every scan task writes its own file. A lost executor only
    repeats its tasks, since files appear when the job commits.
    """
    location = f"{root.rstrip('/')}/{table}/version-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n_rows")).write.parquet(location)
    return Staged(table, location, seen.get["n_rows"])


def publish(spark: SparkSession, database: str, staged: Staged) -> None:
    """Point the table at the staged files.

    Readers see the old version until then, so a failed load never leaves an
    empty table. A table whose columns are unchanged gets a new location. Otherwise
    the new one is declared under a name of its own and the two change names; if that
    fails, the old one gets its name back. Older versions stay on disk.
    """
    name = quoted(database, staged.table)
    new_schema = spark.read.parquet(staged.location).schema
    if not spark.catalog.tableExists(name):
        _declare(spark, name, staged.location)
    elif spark.table(name).schema == new_schema:
        spark.sql(f"ALTER TABLE {name} SET LOCATION {literal(staged.location)}")
    else:
        fresh = quoted(database, f"{staged.table}__new_{uuid.uuid4().hex[:8]}")
        _declare(spark, fresh, staged.location)
        exchange(spark, database, staged.table, fresh)
    spark.catalog.refreshTable(name)


def exchange(spark: SparkSession, database: str, table: str, fresh: str) -> None:
    """Let the table ``fresh``, a quoted name, take the place of ``database.table``, which is dropped; its files stay.

    If that fails, the old table gets its name back and the fresh one is dropped.
    """
    name, old = quoted(database, table), quoted(database, f"{table}__old_{uuid.uuid4().hex[:8]}")
    try:
        _rename(spark, name, old)
        try:
            _rename(spark, fresh, name)
        except Exception:
            _rename(spark, old, name)
            raise
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {fresh}")
        raise
    spark.sql(f"DROP TABLE {old}")


def _declare(spark: SparkSession, name: str, location: str) -> None:
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION {literal(location)}")


def _rename(spark: SparkSession, name: str, to: str) -> None:
    spark.sql(f"ALTER TABLE {name} RENAME TO {to}")


def drop_old_versions(spark: SparkSession, database: str, root: str, table: str) -> int:
    """Remove all versions below ``root`` but the published one; returns how many.

    Readers that still use an older version fail from then on.
    """
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(database, table)}")
    [location] = described.where("col_name = 'Location'").collect()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{table}")
    files = folder.getFileSystem(conf)
    published = jvm.org.apache.hadoop.fs.Path(location["data_type"]).getName()
    old = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName() != published]
    if len(old) == len(files.listStatus(folder)):
        raise ValueError(f"The published version of {table} is not below {root}")
    for path in old:
        files.delete(path, True)
    return len(old)


def refresh_table(df: DataFrame, database: str, root: str, table: str) -> Staged:
    """Replace ``database.table`` by ``df``; runs the write."""
    staged = stage(df, root, table)
    publish(df.sparkSession, database, staged)
    return staged
