"""Rows before and after in an order within a key, and running totals, without one task for a whole key.

Every function takes a bucket: a column that never falls along the order within a key (the day of a time, a turn
number divided by a constant). Windows then run per (key, bucket); what crosses buckets goes through a table with
one row per (key, bucket), which is all that a window per key ever sees. A key with a third of all rows is spread
over its buckets. NULL keys form a key of their own; the caller's order must be total for a defined result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _beside(df: DataFrame, key: str, bucket: Column, order: list[str], value: Column, name: str, ahead: bool) -> DataFrame:
    rows = df.withColumns({"bucket_": bucket, "value_": value})
    within = Window.partitionBy(key, "bucket_").orderBy(*order)
    step, edge = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
    ends = rows.groupBy(key, "bucket_").agg(edge("value_", F.struct(*order)).alias("end_"))
    beside = ends.select(F.col(key).alias("key__"), F.col("bucket_").alias("bucket__"), step("end_").over(Window.partitionBy(key).orderBy(F.col("bucket_").asc_nulls_first())).alias("beside_"))
    rows = rows.withColumn(name, step("value_").over(within))
    joined = rows.join(beside, F.col(key).eqNullSafe(F.col("key__")) & F.col("bucket_").eqNullSafe(F.col("bucket__")), "left")
    return joined.withColumn(name, F.coalesce(name, "beside_")).drop("bucket_", "value_", "key__", "bucket__", "beside_")


def previous_row(df: DataFrame, key: str, bucket: Column, order: list[str], value: Column, name: str = "previous") -> DataFrame:
    """df with the struct value of the row before in the same key; NULL for the first row of a key."""
    return _beside(df, key, bucket, order, value, name, ahead=False)


def next_row(df: DataFrame, key: str, bucket: Column, order: list[str], value: Column, name: str = "next") -> DataFrame:
    """df with the struct value of the row after in the same key; NULL for the last row of a key."""
    return _beside(df, key, bucket, order, value, name, ahead=True)


def running(df: DataFrame, key: str, bucket: Column, order: list[str], sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None) -> DataFrame:
    """df with the sum or maximum of each column over the rows before in the same key (0 and NULL for the first row)."""
    sums, maxes = sums or {}, maxes or {}
    rows = df.withColumn("bucket_", bucket).withColumns({f"in_{n}": c for n, c in {**sums, **maxes}.items()})
    parts = rows.groupBy(key, "bucket_").agg(*[F.sum(f"in_{n}").alias(f"of_{n}") for n in sums], *[F.max(f"in_{n}").alias(f"of_{n}") for n in maxes])
    earlier = Window.partitionBy(key).orderBy(F.col("bucket_").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(key).alias("key__"), F.col("bucket_").alias("bucket__"), *[F.sum(f"of_{n}").over(earlier).alias(f"before_{n}") for n in sums], *[F.max(f"of_{n}").over(earlier).alias(f"before_{n}") for n in maxes])
    within = Window.partitionBy(key, "bucket_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({**{f"here_{n}": F.sum(f"in_{n}").over(within) for n in sums}, **{f"here_{n}": F.max(f"in_{n}").over(within) for n in maxes}})
    joined = rows.join(parts, F.col(key).eqNullSafe(F.col("key__")) & F.col("bucket_").eqNullSafe(F.col("bucket__")), "left")
    zero = F.lit(0)
    made = {**{n: F.coalesce(f"here_{n}", zero) + F.coalesce(f"before_{n}", zero) for n in sums}, **{n: F.greatest(f"here_{n}", f"before_{n}") for n in maxes}}
    return reduce(lambda d, n: d.drop(f"in_{n}", f"here_{n}", f"before_{n}"), made, joined.withColumns(made)).drop("bucket_", "key__", "bucket__")
