"""Small tables made of metadata or settings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ARROW_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}


def small_table(
    spark: SparkSession, fields: Mapping[str, str], rows: Sequence[Sequence]
) -> DataFrame:
    """A table of driver-side rows whose size the optimizer knows.

    It broadcasts such a table in a join while it is under the broadcast
    threshold, and shuffles it otherwise.
    """
    columns = {
        name: pa.array([row[i] for row in rows], ARROW_TYPES[kind])
        for i, (name, kind) in enumerate(fields.items())
    }
    return spark.createDataFrame(pa.table(columns))
