"""Roll-ups behind the dashboards: counts, shares, medians, capped times, timelines, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.dates import utc

#: The cap of a response: ten medians, between one minute and one hour; ten minutes without data. A pair beyond it counts one minute.
MINUTE_MS, CAP_FLOOR_MS, CAP_CEILING_MS, CAP_DEFAULT_MS = 60_000, 60_000, 3_600_000, 600_000


#: What an epoch in milliseconds looks like; other units in the column aren't times here.
IN_MS = "timestamp_ms BETWEEN 100000000000 AND 10000000000000"


def whole_sum(c: Column | str) -> Column:
    """The sum as a bigint, 0 for none."""
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


def top(df: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    """The k rows with the largest by; ties go by the other columns, so the result is defined."""
    return df.orderBy(F.col(by).desc(), *ties).limit(k)


def given(c: str) -> Column:
    """True where a text column isn't NULL or ''."""
    return F.col(c).isNotNull() & (F.col(c) != "")


def share_of_first(df: DataFrame, key: str) -> DataFrame:
    """(key, rows, share_pct) of the most frequent given value and its percentage of all of them."""
    counts = df.where(given(key)).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("total"))
    return top(counts, "rows", 1, key).join(F.broadcast(total)).select(key, "rows", F.round(F.col("rows") * 100.0 / F.col("total"), 1).alias("share_pct"))


def response_cap(turns: DataFrame) -> DataFrame:
    """(median_ms, cap_ms), one row: the median response of assistant turns and the cap made from it."""
    times = turns.where("role = 'assistant' and response_time_ms > 0")
    median = F.coalesce(F.floor(F.median("response_time_ms")).cast("bigint"), F.lit(0).cast("bigint"))
    return times.agg(median.alias("median_ms")).select("median_ms", _cap(F.col("median_ms")).alias("cap_ms"))


def _cap(median: Column) -> Column:
    return F.when(median > 0, F.greatest(F.lit(CAP_FLOOR_MS), F.least(F.lit(CAP_CEILING_MS), median * 10))).otherwise(CAP_DEFAULT_MS).cast("bigint")


def response_caps(turns: DataFrame, key: str) -> DataFrame:
    """(key, median_ms, cap_ms): response_cap of each key's own turns; keys without a response have no row."""
    times = turns.where("role = 'assistant' and response_time_ms > 0").groupBy(key).agg(F.coalesce(F.floor(F.median("response_time_ms")).cast("bigint"), F.lit(0).cast("bigint")).alias("median_ms"))
    return times.withColumn("cap_ms", _cap(F.col("median_ms")))


def agentic_time_within(turns: DataFrame, key: str) -> DataFrame:
    """(key, turns, total_ms): agentic_pairs within each key, with the cap of its own turns (the default for keys without responses)."""
    a = turns.where(f"role = 'assistant' and {IN_MS}").select(key, "session_id", F.col("responding_to_turn").alias("turn"), F.col("timestamp_ms").alias("ms"))
    u = turns.where(f"role = 'user' and {IN_MS}").select(key, "session_id", "turn", F.col("timestamp_ms").alias("user_ms"))
    gap = F.col("ms") - F.col("user_ms")
    met = a.join(u, [key, "session_id", "turn"]).join(response_caps(turns, key).select(key, "cap_ms"), key, "left")
    return met.groupBy(key).agg(F.count(F.lit(1)).alias("turns"), whole_sum(F.when((gap > 0) & (gap <= F.coalesce("cap_ms", F.lit(CAP_DEFAULT_MS))), gap).otherwise(MINUTE_MS)).alias("total_ms"))


def agentic_pairs(turns: DataFrame) -> DataFrame:
    """(session_id, agent, model, user_ms, agentic_ms) of each assistant turn with the user turn it responds to.

    The time is that between the two if it is positive and within the cap, else one minute. The one-row cap is
    broadcast; the two sides meet on (session, turn), so a long session is spread over its turns.
    """
    a = turns.where(f"role = 'assistant' and {IN_MS}").select("session_id", F.col("responding_to_turn").alias("turn"), F.col("agent_used").alias("agent"), F.col("model_id").alias("model"), F.col("timestamp_ms").alias("ms"))
    u = turns.where(f"role = 'user' and {IN_MS}").select("session_id", "turn", F.col("agent_used").alias("user_agent"), F.col("model_id").alias("user_model"), F.col("timestamp_ms").alias("user_ms"))
    gap = F.col("ms") - F.col("user_ms")
    met = a.join(u, ["session_id", "turn"]).join(F.broadcast(response_cap(turns)))
    return met.select("session_id", F.coalesce("agent", "user_agent", F.lit("unknown")).alias("agent"), F.coalesce("model", "user_model", F.lit("unknown")).alias("model"), "user_ms", F.when((gap > 0) & (gap <= F.col("cap_ms")), gap).otherwise(MINUTE_MS).alias("agentic_ms"))


def agentic_time(turns: DataFrame, key: str) -> DataFrame:
    """(key, turns, total_ms, hours) per agent or model."""
    sums = agentic_pairs(turns).where(F.col(key) != "").groupBy(key).agg(F.count(F.lit(1)).alias("turns"), whole_sum("agentic_ms").alias("total_ms"))
    return sums.withColumn("hours", F.round(F.col("total_ms") / 3_600_000.0, 2))


def heatmap(turns: DataFrame, monday_goes_back: bool = True) -> DataFrame:
    """(bucket, hour, total_ms): agentic time by day, or week where users' turns span over 90 days, and hour in UTC.

    The last 365 days count. A week is named by its Monday; with monday_goes_back a Monday belongs to the week
    before, as the dashboards have it.
    """
    span = turns.where(f"role = 'user' and {IN_MS}").agg(F.min("timestamp_ms").alias("first"), F.max("timestamp_ms").alias("last"))
    year, quarter = 365 * 86_400_000, 90 * 86_400_000
    pairs = agentic_pairs(turns).join(F.broadcast(span)).where(F.col("user_ms") >= F.when(F.col("last") - F.col("first") <= year, F.col("first")).otherwise(F.col("last") - year))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("user_ms") / 86_400_000).cast("int"))
    monday = F.date_sub(day, F.weekday(day)) if not monday_goes_back else F.when(F.weekday(day) == 0, F.date_sub(day, 7)).otherwise(F.date_sub(day, F.weekday(day)))
    bucket = F.when(F.col("last") - F.col("first") <= quarter, day).otherwise(monday)
    hour = F.floor(F.pmod(F.col("user_ms"), F.lit(86_400_000)) / 3_600_000).cast("int")
    return pairs.groupBy(bucket.alias("bucket"), hour.alias("hour")).agg(whole_sum("agentic_ms").alias("total_ms"))


def per_day(turns: DataFrame, iso: str = "timestamp_iso") -> DataFrame:
    """turns with a column day, the UTC date of its ISO text; rows without one are left out."""
    return turns.withColumn("day", F.to_date(utc(F.col(iso)))).where("day is not null")


def pivot_top(df: DataFrame, key: str, row: str, k: int) -> DataFrame:
    """(row, key, rows): counts per row for the k most frequent keys, 0 where a row has none: the pivot in long form."""
    best = top(df.where(given(key)).groupBy(key).agg(F.count(F.lit(1)).alias("n")), "n", k, key).select(key)
    counts = df.join(F.broadcast(best), key).groupBy(row, key).agg(F.count(F.lit(1)).alias("rows"))
    # k keys times the days: a grid of bounded width
    grid = counts.select(row).distinct().join(F.broadcast(best))
    return grid.join(counts, [row, key], "left").select(row, key, F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"))


def text_list(c: Column) -> Column:
    """The strings of a JSON array in a text column; an object counts by its name; empty for anything else."""
    parsed = F.from_json(F.when(c.startswith("["), c), "array<string>")
    names = F.transform(parsed, lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.name")).otherwise(x))
    return F.coalesce(F.filter(names, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def word_counts(df: DataFrame, text: str, stop: tuple[str, ...], least: int = 3) -> DataFrame:
    """(word, rows): how often each word occurs, over whole texts; words start with a letter and aren't stop words."""
    found = df.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z][a-z0-9_]+"), F.lit(0))).alias("word"))
    return found.where((F.length("word") >= least) & ~F.col("word").isin(*stop)).groupBy("word").agg(F.count(F.lit(1)).alias("rows"))


def ranked(df: DataFrame, group: str, by: str, k: int, *ties: str) -> DataFrame:
    """The k largest rows of each group, with their rank from 1. A window per group: of aggregated rows, not of the data."""
    w = Window.partitionBy(group).orderBy(F.col(by).desc(), *ties)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
