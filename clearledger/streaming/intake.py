"""Continuous loading: files that arrive in a folder are cleaned and masked.

The types must be known beforehand, since a whole-table check cannot run on a
stream. Everything else is the same projection as in the batch load.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from clearledger.operators.masking import apply_policy
from clearledger.operators.typing import apply_types
from clearledger.specs import MaskPolicy, TableSpec


def arriving(
    spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1000
) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def clean_and_mask(
    stream: DataFrame, spec: TableSpec, types: Mapping[str, str], policy: MaskPolicy | None = None
) -> DataFrame:
    typed = apply_types(stream, spec, types)
    return apply_policy(typed, policy) if policy else typed


def append_to(cleaned: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived, exactly once per checkpoint, then stop.

    ``checkpoint`` must be a folder that survives the loss of any machine.
    """
    return (
        cleaned.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(folder)
    )
