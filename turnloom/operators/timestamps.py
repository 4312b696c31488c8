"""One UTC instant for records whose time is stated in several fields, forms, precisions and zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import instants as I

#: 2024-01-01 and 2027-01-01 with a day at either side, in ms: the span of numbers that are readable, unless another is given.
SPAN_MS = (1_703_980_800_000, 1_798_848_000_000)


def session_zones(sessions: DataFrame, session: str = "session_id", metadata: str = "metadata_json") -> DataFrame:
    """(session_key, session_zone): the "timezone" of each session that states a known one.

    Sessions without one have no row. A session given more than once takes the least zone name,
    so that the result doesn't depend on the order of rows.
    """
    known = I.known_zones(sessions.sparkSession)
    return (
        sessions.select(F.col(session).alias("session_key"), F.get_json_object(metadata, "$.timezone").alias("session_zone"))
        .where(F.col("session_key").isNotNull() & F.col("session_zone").isin(known))
        .groupBy("session_key").agg(F.min("session_zone").alias("session_zone"))
    )


def _read(df: DataFrame, value: Column, kind: str, zones: list[str], span: tuple[int, int]) -> DataFrame:
    """df with utc_ and wall_ set from value where both are NULL so far and value is readable.

    Each step is a projection of its own: one large expression would repeat its parts many times.
    """
    open_ = F.col("utc_").isNull() & F.col("wall_").isNull()
    if kind == "number":
        return df.withColumn("utc_", F.when(open_ & (value > 0), I.epoch_ms(value, *span)).otherwise(F.col("utc_")))
    df = df.withColumn("value_", F.when(open_ & (F.length(value) >= 8), value))
    df = df.withColumn("number_", F.when(F.col("value_").rlike(r"^\s*\d{9,19}(\.\d+)?\s*$"), F.trim("value_").try_cast("decimal(38,9)")))
    df = df.withColumn("parts_", F.when(F.col("number_").isNull(), I.split_wall(F.col("value_"))))
    df = df.withColumns({"date_": I.date_of(F.col("parts_")), "zone_": F.col("parts_")[9], "named_": F.col("parts_")[10]})
    df = df.withColumn("ms_", I.wall_ms(F.col("date_"), F.col("parts_")))
    df = df.withColumn("ms_", F.when(F.col("ms_").between(*span), F.col("ms_")))
    # an offset outranks a name; a zone text that no one knows makes the value unreadable
    df = df.withColumn("stated_", F.coalesce(F.nullif(F.col("zone_"), F.lit("")), F.col("named_")))
    df = df.withColumn("minutes_", F.when(F.col("stated_") != "", I.offset_minutes(F.col("stated_"))))
    region = F.when(F.col("stated_").isin(zones), F.col("stated_"))
    utc = F.coalesce(
        I.epoch_ms(F.col("number_"), *span),
        F.col("ms_") - F.col("minutes_").cast("long") * 60_000,
        F.when(F.col("stated_") != "", I.zone_to_utc_ms(F.col("ms_"), region)),
    )
    df = df.withColumns({"utc_": F.coalesce("utc_", utc), "wall_": F.coalesce("wall_", F.when(F.col("stated_") == "", F.col("ms_")))})
    return df.drop("value_", "number_", "parts_", "date_", "zone_", "named_", "ms_", "stated_", "minutes_")


def normalise_times(
    records: DataFrame,
    sessions: DataFrame,
    fields: tuple[tuple[str, str], ...] = (("timestamp_ms", "number"), ("timestamp_iso", "text"), ("ts", "text")),
    key: str = "id",
    session: str = "session_id",
    span: tuple[int, int] = SPAN_MS,
) -> DataFrame:
    """(key, utc_ms) for each record: the first readable field as an instant in UTC, in whole milliseconds.

    * An offset in a value outranks a zone name beside it; a zone abbreviation counts as an offset.
    * A value without any zone is wall time in its session's zone, or UTC where the session states none
      (or a zone that isn't known).
    * Zero, negative and out-of-span numbers (span, in ms), impossible dates and unknown zone names aren't readable;
      the next field then counts. utc_ms is NULL where no field is readable.
    * Repeated rows give repeated rows; other columns of the record are ignored whatever their names.
    * Empty tables give an empty result. Numbers are cut off, not rounded.

    Only (key, session, two numbers) are shuffled for the zone look-up, on the session; a session with a
    large share of all rows is split by the adaptive skew join, since the record side is the outer one.
    """
    zones = I.known_zones(records.sparkSession)
    named = [f"field{i}_" for i in range(len(fields))]
    read = records.select(F.col(key).alias("key_"), F.col(session).alias("session_"), *[F.col(name).alias(as_) for (name, _), as_ in zip(fields, named)])
    read = read.withColumns({"utc_": F.lit(None).cast("long"), "wall_": F.lit(None).cast("long")})
    for (_, kind), as_ in zip(fields, named):
        read = _read(read, F.col(as_), kind, zones, span)
    read = read.select("key_", "session_", "utc_", "wall_")
    zoned = read.join(session_zones(sessions), F.col("session_") == F.col("session_key"), "left")
    local = F.when(F.col("wall_").isNotNull(), I.zone_to_utc_ms(F.col("wall_"), F.coalesce("session_zone", F.lit("UTC"))))
    return zoned.select(F.col("key_").alias(key), F.coalesce("utc_", local).alias("utc_ms"))
