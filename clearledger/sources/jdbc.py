"""Relational databases over JDBC.

The driver jar and the credentials belong to the submitting environment.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Connection:
    url: str
    user: str
    password: str = field(repr=False)
    driver: str = "org.postgresql.Driver"
    connect_timeout_seconds: int = 30

    def options(self) -> dict[str, str]:
        return {
            "url": self.url,
            "user": self.user,
            "password": self.password,
            "driver": self.driver,
            "loginTimeout": str(self.connect_timeout_seconds),
        }


@dataclass(frozen=True)
class Slices:
    """A numeric, date or timestamp column to read in parallel ranges."""

    column: str
    lower: str
    upper: str
    count: int

    def options(self) -> dict[str, str]:
        return {
            "partitionColumn": self.column,
            "lowerBound": self.lower,
            "upperBound": self.upper,
            "numPartitions": str(self.count),
        }


def quoted_table(table: str) -> str:
    return '"' + table.replace('"', '""') + '"'


def read_options(connection: Connection, table: str, slices: Slices | None) -> dict[str, str]:
    options = connection.options() | {"dbtable": quoted_table(table), "fetchsize": "10000"}
    return options | (slices.options() if slices else {})


def write_options(connection: Connection, table: str, batch: int, writers: int) -> dict[str, str]:
    return connection.options() | {
        "dbtable": quoted_table(table),
        "batchsize": str(batch),
        "numPartitions": str(writers),
    }


def read_table(
    spark: SparkSession, connection: Connection, table: str, slices: Slices | None = None
) -> DataFrame:
    """Filters and columns are pushed to the database; slices give parallel reads."""
    return spark.read.format("jdbc").options(**read_options(connection, table, slices)).load()


def write_table(
    df: DataFrame, connection: Connection, table: str, batch: int = 5000, writers: int = 16
) -> None:
    """Replace a database table; ``writers`` bounds the open connections."""
    options = write_options(connection, table, batch, writers)
    df.write.format("jdbc").options(**options).mode("overwrite").save()
