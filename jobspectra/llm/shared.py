"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from jobspectra.session import shared_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and go on from its files: nothing before it runs again, and an
    executor that is lost takes nothing with it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/text-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
