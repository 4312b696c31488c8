"""The batch form of the streaming roll-ups, over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.plans.registry import query
from turnloom.sources.tables import table
from turnloom.streaming import ingest


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS rows FROM events GROUP BY 1, 2")
def x01_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    """Events per hour and type."""
    return ingest.tumbling(_events(spark, folder), "1 hour", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT w.start AS start, event_type, count(*) AS rows FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) w GROUP BY 1, 2""")
def x02_sliding(spark: SparkSession, folder: str) -> DataFrame:
    """Events per hour that slides by half an hour."""
    return ingest.tumbling(_events(spark, folder), "1 hour", "event_type", slide="30 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH f AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM f)
SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS rows FROM s GROUP BY user_id, session""")
def x03_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of a user's events less than half an hour apart."""
    return ingest.sessions(_events(spark, folder), "30 minutes", "user_id").withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})
