"""Readers of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table `name` under a folder."""
    return spark.read.parquet(f"{base}/{name}.parquet")
