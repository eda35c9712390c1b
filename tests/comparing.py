"""Compare a Spark result with the rows DuckDB gives for the same tables."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import duckdb
from pyspark.sql import DataFrame

from clearledger.plans.registry import TABLES


def duck_rows(sql: str, folder: str) -> tuple[list[str], list[str], list[tuple]]:
    with duckdb.connect() as db:
        for table in TABLES:
            db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
        result = db.sql(sql)
        return result.columns, [str(t) for t in result.types], result.fetchall()


def _cell(value):
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, (int, Decimal)):
        return f"{float(value):.9g}" if isinstance(value, Decimal) else str(value)
    if isinstance(value, float):
        return str(int(value)) if math.isfinite(value) and value == int(value) else f"{value:.9g}"
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return str(value)


def sorted_rows(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df: DataFrame, sql: str, folder: str) -> str:
    """Empty when both sides have the same columns and rows."""
    columns, kinds, rows = duck_rows(sql, folder)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    ours, theirs = sorted_rows(df.columns, df.collect()), sorted_rows(columns, rows)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else ""


# Which DuckDB type each Spark type should meet.
TYPE_PAIRS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def type_differences(df: DataFrame, sql: str, folder: str) -> dict[str, tuple[str, str]]:
    columns, kinds, _ = duck_rows(f"SELECT * FROM ({sql}) LIMIT 0", folder)
    theirs = dict(zip(columns, kinds, strict=True))
    ours = dict(df.dtypes)
    return {
        name: (kind, theirs[name])
        for name, kind in ours.items()
        if name in theirs and TYPE_PAIRS.get(kind, kind) != theirs[name]
    }
