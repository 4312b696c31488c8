"""Turns from events and exchanges from turns: pairing, response times, running tokens, runs of one role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.operators.neighbours import next_row, previous_row, running

COLUMNS = ("id", "session_id", "turn", "role", "original_text", "model_id", "timestamp_ms", "response_time_ms", "original_text_tokens", "code_tokens", "tool_tokens", "system_tokens", "total_lines_added", "total_lines_removed")
#: Turns of a session in one window task, at most (a turn number given once).
SPAN = 4096


def _bucket() -> Column:
    return F.floor(F.col("turn") / SPAN)


def ordered(turns: DataFrame) -> DataFrame:
    """The rows that have a place, session and turn given, with the columns that matter here."""
    return turns.select(*COLUMNS).where("session_id is not null and turn is not null")


def combined_turns(turns: DataFrame) -> DataFrame:
    """One row per user turn with the reply that follows it directly: an exchange.

    (id, session_id, exchange_index, user_turn, user_text, assistant_turn, assistant_text, model_id,
    has_assistant_response, total_tokens, lines_added, lines_removed). The model is the assistant's, else the user's; texts default to ''.
    exchange_index counts the user turns of a session from 0. The order is (turn, id), so turns stated twice stay apart.
    """
    reply = F.struct("turn", "role", "original_text", "model_id", "original_text_tokens", "total_lines_added", "total_lines_removed")
    rows = next_row(ordered(turns), "session_id", _bucket(), ["turn", "id"], reply)
    rows = running(rows, "session_id", _bucket(), ["turn", "id"], sums={"exchange_index": F.when(F.col("role") == "user", 1).otherwise(0)})
    paired = F.coalesce(F.col("next.role") == "assistant", F.lit(False))
    of = lambda name: F.when(paired, F.col(f"next.{name}"))
    empty = F.lit("")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return rows.where("role = 'user'").select(
        F.concat_ws("_", "session_id", F.col("exchange_index").cast("string")).alias("id"), "session_id", F.col("exchange_index").cast("bigint").alias("exchange_index"),
        F.col("turn").alias("user_turn"), F.coalesce("original_text", empty).alias("user_text"), of("turn").alias("assistant_turn"), F.coalesce(of("original_text"), empty).alias("assistant_text"),
        F.coalesce(F.nullif(of("model_id"), empty), "model_id", empty).alias("model_id"), paired.alias("has_assistant_response"),
        (number(F.col("original_text_tokens")) + number(of("original_text_tokens"))).alias("total_tokens"), number(of("total_lines_added")).alias("lines_added"), number(of("total_lines_removed")).alias("lines_removed"),
    )


def responses(turns: DataFrame) -> DataFrame:
    """(id, session_id, turn, responding_to, response_ms) of each assistant turn.

    It responds to the last user turn before it in its session; a response time that the source gives wins over
    the difference of the times, and a negative one is NULL. Without a user turn before both are NULL.
    """
    user = F.when(F.col("role") == "user", F.struct(F.col("turn").alias("t"), F.col("id").alias("i"), F.col("timestamp_ms").alias("ms")))
    rows = running(ordered(turns), "session_id", _bucket(), ["turn", "id"], maxes={"user": user}).where("role = 'assistant'")
    known = F.when((F.col("timestamp_ms") > 0) & (F.col("user.ms") > 0), F.col("timestamp_ms") - F.col("user.ms"))
    ms = F.when(F.col("user.t").isNotNull(), F.coalesce("response_time_ms", known))
    return rows.select("id", "session_id", "turn", F.col("user.t").alias("responding_to"), F.when(ms >= 0, ms).alias("response_ms"))


def history_tokens(turns: DataFrame) -> DataFrame:
    """(id, session_id, turn, total_tokens, history_tokens): the tokens of a turn and those of its session before it."""
    total = F.coalesce("original_text_tokens", F.lit(0)) + F.coalesce("code_tokens", F.lit(0)) + F.coalesce("tool_tokens", F.lit(0)) + F.coalesce("system_tokens", F.lit(0))
    rows = running(ordered(turns).withColumn("total_tokens", total), "session_id", _bucket(), ["turn", "id"], sums={"history_tokens": F.col("total_tokens")})
    return rows.select("id", "session_id", "turn", "total_tokens", F.col("history_tokens").cast("bigint").alias("history_tokens"))


def role_runs(turns: DataFrame) -> DataFrame:
    """(session_id, run, role, rows, first_turn, last_turn, text_chars, first_ms, tokens): neighbouring turns of one role as one."""
    rows = previous_row(ordered(turns).where("role is not null"), "session_id", _bucket(), ["turn", "id"], F.struct("role"))
    changed = F.coalesce(F.col("role") != F.col("previous.role"), F.lit(True)).cast("int")
    rows = running(rows.withColumn("changed", changed), "session_id", _bucket(), ["turn", "id"], sums={"earlier": F.col("changed")})
    return rows.withColumn("run", (F.col("earlier") + F.col("changed") - 1).cast("bigint")).groupBy("session_id", "run", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum(F.coalesce(F.length("original_text"), F.lit(0)).cast("bigint")).alias("text_chars"),
        F.min(F.when(F.col("timestamp_ms") > 0, F.col("timestamp_ms"))).alias("first_ms"), F.sum(F.coalesce("original_text_tokens", F.lit(0))).cast("bigint").alias("tokens"),
    )
