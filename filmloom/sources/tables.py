"""Staged Parquet tables, one file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder`; timestamps stay without zone, as they are stored."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
