"""Reading the canonical tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table called name; columns are pruned and filters pushed down by the plan that uses it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
