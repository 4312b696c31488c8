"""Keeping tables: latest rows, merged fragments, cascaded deletes, partitions replaced as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One row per key, the one with the largest by: what remains after upserts in that order. Rows with a NULL key stay apart by their other columns."""
    columns = df.columns
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), by).alias("row_")).select("row_.*")


def merged_fragments(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per session from fragments: the last given title and path, the earliest start, the latest end."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col(order))).alias(c)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(last("title"), last("source_path"), F.min("started_at_ms").alias("started_at_ms"), F.max("ended_at_ms").alias("ended_at_ms"), F.count(F.lit(1)).alias("fragments"))


def without(df: DataFrame, gone: DataFrame, column: str, key: str) -> DataFrame:
    """df less the rows whose column names a key of gone; NULLs stay."""
    return df.join(gone.select(F.col(key).alias("gone_")).distinct(), F.col(column) == F.col("gone_"), "left_anti")


def replaced(df: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """df with all rows of each key that incoming has replaced by the incoming rows; both have the same columns, and rows with a NULL key are kept beside each other."""
    return without(df, incoming.where(F.col(key).isNotNull()), key, key).unionByName(incoming)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Writes df so that the partitions it holds replace those on disk and the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, NULLs left out."""
    df.write.mode("overwrite").json(path)
