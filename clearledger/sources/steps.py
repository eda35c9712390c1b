"""Tables between the steps of a job."""

from __future__ import annotations

from pyspark.sql import DataFrame

from clearledger.session import shared_folder


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write a step's rows to the folder all executors share and read them back.

    What follows doesn't repeat the step if an executor is lost, nor deals its rows out
    otherwise the second time.
    """
    place = shared_folder(df.sparkSession, purpose)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)
