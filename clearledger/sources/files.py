"""Parquet tables and the views over them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def scan(spark: SparkSession, folder: str, source: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{source}")


def scan_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return scan(spark, folder, f"{table}.parquet")


def register_views(spark: SparkSession, folder: str, tables: Iterable[str]) -> None:
    """Make parquet tables available to SQL under their own names."""
    for table in tables:
        scan_table(spark, folder, table).createOrReplaceTempView(table)
