"""Incremental ingest and roll-ups with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tailed(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(line, file, taken_at) of the JSONL files of a folder as they arrive; the checkpoint remembers which are done."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).format("text").load(folder)
    return lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.current_timestamp().alias("taken_at"))


def events(lines: DataFrame) -> DataFrame:
    """(session_id, event_id, role, ts, text) of lines that are messages; others are left out."""
    get = lambda p: F.get_json_object("line", f"$.{p}")
    return lines.select(F.coalesce(get("sessionId"), get("session_id"), F.col("file")).alias("session_id"), F.coalesce(get("uuid"), get("id")).alias("event_id"), F.coalesce(get("message.role"), get("role"), get("type")).alias("role"), F.to_timestamp(get("timestamp")).alias("ts"), F.coalesce(get("message.content"), get("content")).alias("text")).where("role is not null")


def once(df: DataFrame, late: str = "1 hour") -> DataFrame:
    """df without repeats of an event that come within the lateness; state is bounded by it."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id", "event_id"])


def tumbling(df: DataFrame, width: str, key: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, key, rows) per window of width, sliding if slide is given."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return df.withWatermark("ts", late).groupBy(window, key).agg(F.count(F.lit(1)).alias("rows")).select(F.col("window.start").alias("start"), key, "rows")


def sessions(df: DataFrame, gap: str, key: str, late: str = "10 minutes") -> DataFrame:
    """(start, end, key, rows) per run of rows of a key that are less than gap apart."""
    return df.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("rows")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "rows")


def upserting(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a query that hands each batch to write once all that is there is taken; a batch that runs again has the same number."""
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
