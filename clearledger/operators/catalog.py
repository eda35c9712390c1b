"""What tables there are and what they look like."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearledger.operators.typing import column
from clearledger.sources.small import small_table
from clearledger.sources.tables import quoted

# Displayed type names, name shape, kinds of tables and messages.
TYPE_NAMES = {
    "boolean": "boolean",
    "tinyint": "smallint",
    "smallint": "smallint",
    "int": "integer",
    "bigint": "bigint",
    "float": "real",
    "double": "double precision",
    "string": "text",
    "date": "date",
    "timestamp": "timestamp with time zone",
    "timestamp_ntz": "timestamp without time zone",
    "binary": "bytea",
}
NAME_PATTERN = r"^[a-zA-Z_][a-zA-Z0-9_]*$"
BASE_TABLE = "BASE TABLE"
NO_TABLES = "No tables found in the public schema."
NAME_REQUIRED = "table_name is required"
NAME_INVALID = "Invalid table name"
SAMPLE_ROWS = 3

TABLE_FIELDS = {"table_schema": "string", "table_name": "string", "table_type": "string"}
COLUMN_FIELDS = {
    "table_schema": "string",
    "table_name": "string",
    "ordinal_position": "int",
    "column_name": "string",
    "data_type": "string",
    "is_nullable": "boolean",
}
DESCRIBED_FIELDS = {"column": "string", "type": "string", "nullable": "boolean"}


def not_found(table: str) -> str:
    return f"Table '{table}' not found in public schema"


def display_type(spark_type: str) -> str:
    name = spark_type.lower()
    if name.startswith("decimal"):
        return "numeric"
    if name.startswith("array<"):
        return "ARRAY"
    return TYPE_NAMES.get(name, name)


@dataclass(frozen=True)
class Catalog:
    """Table and column metadata as two DataFrames that join on schema and name."""

    tables: DataFrame
    columns: DataFrame


def _column_rows(schema_name: str, table: str, schema: T.StructType) -> list[tuple]:
    return [
        (schema_name, table, i + 1, f.name, display_type(f.dataType.simpleString()), f.nullable)
        for i, f in enumerate(schema.fields)
    ]


def catalog_of(spark: SparkSession, schemas: Mapping[str, T.StructType], name: str) -> Catalog:
    """Metadata of the given table schemas under the schema ``name``."""
    tables = [(name, table, BASE_TABLE) for table in schemas]
    columns = [row for table, schema in schemas.items() for row in _column_rows(name, table, schema)]
    return Catalog(
        small_table(spark, TABLE_FIELDS, tables),
        small_table(spark, COLUMN_FIELDS, columns),
    )


def session_catalog(spark: SparkSession, database: str | None = None) -> Catalog:
    """Metadata of a database's tables, read anew at each call.

    Temporary views belong to the session and may be called like a table: they are
    listed under an empty schema and marked as views, so the operators below leave them out.
    """
    database = database or spark.catalog.currentDatabase()
    tables, columns = [], []
    for entry in spark.catalog.listTables(database):
        is_view = entry.isTemporary or entry.tableType == "VIEW"
        schema = "" if entry.isTemporary else database
        tables.append((schema, entry.name, "VIEW" if is_view else BASE_TABLE))
        path = [entry.name] if entry.isTemporary else [database, entry.name]
        columns += _column_rows(schema, entry.name, spark.table(quoted(*path)).schema)
    return Catalog(
        small_table(spark, TABLE_FIELDS, tables),
        small_table(spark, COLUMN_FIELDS, columns),
    )


def list_columns(catalog: Catalog, schema: str) -> DataFrame:
    """One row per column of the schema's base tables."""
    keys = ["table_schema", "table_name"]
    wanted = (F.col("table_schema") == schema) & (F.col("table_type") == BASE_TABLE)
    return catalog.columns.join(catalog.tables, keys).where(wanted).drop("table_schema", "table_type")


def _in_order(item: Column) -> Column:
    """Items of one table by column position; bounded by its width."""
    pairs = F.sort_array(F.collect_list(F.struct("ordinal_position", item.alias("item"))))
    return F.transform(pairs, lambda p: p["item"])


def list_tables(catalog: Catalog, schema: str) -> DataFrame:
    """One row per base table with its columns and types in order."""
    entry = F.struct(F.col("column_name").alias("column"), F.col("data_type").alias("type"))
    return (
        list_columns(catalog, schema).groupBy("table_name").agg(_in_order(entry).alias("columns"))
    )


def schema_lines(catalog: Catalog, schema: str) -> DataFrame:
    """``Table: name (column TYPE, ...)`` per base table."""
    item = F.concat(
        F.col("column_name"),
        F.lit(" "),
        F.upper("data_type"),
        F.when(F.col("is_nullable"), "").otherwise(" NOT NULL"),
    )
    line = F.concat(
        F.lit("Table: "),
        F.col("table_name"),
        F.lit(" ("),
        F.array_join(_in_order(item), ", "),
        F.lit(")"),
    )
    return list_columns(catalog, schema).groupBy("table_name").agg(line.alias("line"))


def schema_text(catalog: Catalog, schema: str) -> str:
    """All schema lines as one text; collects one row per table."""
    lines = [row["line"] for row in schema_lines(catalog, schema).orderBy("table_name").collect()]
    return "\n".join(lines) or NO_TABLES


@dataclass(frozen=True)
class Description:
    columns: DataFrame
    sample_rows: DataFrame


def checked_name(table: str | None) -> str:
    name = (table or "").strip()
    if not name:
        raise ValueError(NAME_REQUIRED)
    if not re.match(NAME_PATTERN, name):
        raise ValueError(NAME_INVALID)
    return name


def sample_rows(df: DataFrame, order_by: Iterable[str] = ()) -> DataFrame:
    """Three rows: the first by ``order_by``, or any three."""
    keys = [column(k) for k in order_by]
    return (df.orderBy(*keys) if keys else df).limit(SAMPLE_ROWS)


def describe_table(
    spark: SparkSession, table: str | None, database: str | None = None, order_by: Iterable[str] = ()
) -> Description:
    """Columns with type and nullability, and sample rows, of one base table."""
    name = checked_name(table)
    database = database or spark.catalog.currentDatabase()
    entries = [
        t for t in spark.catalog.listTables(database, name) if t.name == name and not t.isTemporary
    ]
    if not entries:
        raise ValueError(not_found(name))
    df = spark.table(quoted(database, name))
    described = [(r[3], r[4], r[5]) for r in _column_rows(database, name, df.schema)]
    columns = small_table(spark, DESCRIBED_FIELDS, described)
    return Description(columns, sample_rows(df, order_by))


def table_profile(df: DataFrame) -> DataFrame:
    """Rows and missing values per column, from one aggregate over the table."""
    names = df.columns
    counts = [F.count(column(n)).alias(f"c{i}") for i, n in enumerate(names)]
    entries = [
        F.struct(
            F.lit(n).alias("column_name"),
            F.col("n_rows").alias("n_rows"),
            (F.col("n_rows") - F.col(f"c{i}")).alias("n_missing"),
        )
        for i, n in enumerate(names)
    ]
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"), *counts)
    return counted.select(F.inline(F.array(*entries)))
