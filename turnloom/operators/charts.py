"""What charts do to their data: others, buckets of time, shares, filled gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.text import trimmed


def top_and_others(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The k largest keys and one row 'others' with the sum of the rest, if there is a rest. NULL keys are left out."""
    rows = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.sum(value).cast("bigint").alias(value))
    best = rows.orderBy(F.col(value).desc(), key).limit(k).select(key, F.lit(True).alias("best"))
    marked = rows.join(F.broadcast(best), key, "left")
    return marked.groupBy(F.when(F.col("best"), F.col(key)).otherwise("others").alias(key)).agg(F.sum(value).cast("bigint").alias(value))


def time_bucket(ts: Column, first: Column, last: Column) -> Column:
    """The start of the hour, day, ISO week, month or year of ts, by the span of the data (24 hours, 14 days, 12 weeks, 24 months)."""
    hours = (F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 3_600_000_000
    unit = lambda u: F.date_trunc(u, ts).cast("timestamp_ntz")
    return F.when(hours <= 24, unit("hour")).when(hours <= 24 * 14, unit("day")).when(hours <= 24 * 84, unit("week")).when(hours <= 24 * 730, unit("month")).otherwise(unit("year"))


def rebucketed(df: DataFrame, ts: str, key: str) -> DataFrame:
    """(bucket, key, rows) with buckets that suit the span of all rows."""
    span = df.agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    return df.where(F.col(ts).isNotNull()).join(F.broadcast(span)).groupBy(time_bucket(F.col(ts), F.col("first"), F.col("last")).alias("bucket"), key).agg(F.count(F.lit(1)).alias("rows"))


def percent(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each row's percentage of the whole, one decimal; NULL where the whole is 0."""
    total = df.agg(F.sum(value).alias("total"))
    return df.join(F.broadcast(total)).select(key, value, F.round(F.try_divide(F.col(value) * 100.0, F.col("total")), 1).alias("pct"))


def filled_days(df: DataFrame, day: str, value: str) -> DataFrame:
    """Every day from the first to the last with its value, 0 for a gap, and an intensity log(n + 1) / log(max + 1)."""
    span = df.agg(F.min(day).alias("first"), F.max(day).alias("last"), F.max(value).alias("most"))
    days = span.where("first is not null").select(F.explode(F.sequence("first", "last")).alias("d_"), "most")
    rows = days.join(df, F.col("d_") == F.col(day), "left").select(F.col("d_").alias(day), F.coalesce(value, F.lit(0)).cast("bigint").alias(value), "most")
    return rows.select(day, value, F.round(F.try_divide(F.log(F.col(value) + 1.0), F.log(F.col("most") + 1.0)), 6).alias("intensity"))


def dense(df: DataFrame, row: str, column: str, columns: int, value: str) -> DataFrame:
    """A grid of every row with every column from 0, 0 where there is no value."""
    grid = df.select(row).distinct().select(row, F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias(column))
    return grid.join(df.select(row, column, value), [row, column], "left").select(row, column, F.coalesce(value, F.lit(0)).cast("bigint").alias(value))


def weights(df: DataFrame, value: str) -> DataFrame:
    """df with weight: values scaled from 0 to 1 between the least and the largest, to the power 0.8; 1 where all are equal."""
    span = df.agg(F.min(value).alias("low_"), F.max(value).alias("high_"))
    scaled = F.coalesce(F.try_divide(F.col(value) - F.col("low_"), F.col("high_") - F.col("low_")), F.lit(1.0))
    return df.join(F.broadcast(span)).withColumn("weight", F.round(F.pow(scaled, F.lit(0.8)), 6)).drop("low_", "high_")


def page(df: DataFrame, number: int, size: int, *order: Column | str) -> DataFrame:
    """One page of an ordered result; number from 1, size from 1 to 100."""
    size = max(1, min(100, size))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """A small report with a row number."""
    return df.withColumn("row", F.row_number().over(Window.orderBy(*order)))


def scatter(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, x, y) of the rows whose coordinates are both numbers, neither NULL, NaN nor infinite."""
    number = lambda c: F.col(c).cast("double")
    finite = lambda c: F.coalesce(F.abs(number(c)) < float("inf"), F.lit(False)) & ~F.isnan(number(c))
    return df.where(finite(x) & finite(y)).select(key, number(x).alias("x"), number(y).alias("y"))


def quoted(value: Column) -> Column:
    """Struct(speaker, text) of 'user: text' or 'assistant: text', quotes around the text left out; any other text has no speaker."""
    v = trimmed(F.coalesce(value, F.lit("")))
    said = v.rlike(r"(?i)^(user|assistant)\s*:\s*.+$")
    text = trimmed(F.regexp_replace(v, r"(?i)^(user|assistant)\s*:\s*", ""))
    inside = text.rlike(r"""(?s)^(?:'.*'|".*")$""") & (F.length(text) >= 2)
    bare = F.when(inside, trimmed(F.call_function("substring", text, F.lit(2), F.length(text) - 2))).otherwise(text)
    return F.struct(F.when(said, F.lower(F.regexp_extract(v, r"(?i)^(user|assistant)", 1))).alias("speaker"), F.when(said, bare).otherwise(v).alias("text"))
