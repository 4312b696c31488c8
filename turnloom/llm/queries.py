"""Queries of the training-data problems on text, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import conversations, lookalikes, mixture, neardup, pii, secrets, tokens
from turnloom.llm.sql import SQL  # noqa: F401
from turnloom.sources.tables import table


def _fields(spark: SparkSession, folder: str, *fields: tuple[str, str]) -> DataFrame:
    """(src, row_id, field, text) of columns of several tables."""
    parts = [table(spark, folder, t).select(F.lit(t).alias("src"), F.col("id").alias("row_id"), F.lit(c).alias("field"), F.col(c).alias("text")) for t, c in fields]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


_PERSONAL = (("turns", "original_text"), ("parsed_tool_calls", "arguments_text"))
_SECRET = (("turns", "original_text"), ("turn_tool_calls", "arguments_text"), ("turn_tool_calls", "results_json"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each kind of personal information that a row holds."""
    return pii.found(_fields(spark, folder, *_PERSONAL))


def p1_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every row with typed placeholders for personal information."""
    return pii.scanned(_fields(spark, folder, *_PERSONAL))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each kind of credential that a field holds."""
    return secrets.found(_fields(spark, folder, *_SECRET))


def p2_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every field with its credentials redacted."""
    return secrets.scanned(_fields(spark, folder, *_SECRET))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each session that isn't whole, with the first reason that holds."""
    return conversations.dropped(_messages(spark, folder))


def p5_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """The whole sessions, a row per message in order."""
    return conversations.conversations(_messages(spark, folder))


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "turns").select("id", "session_id", "turn", "role", "original_text")


#: Problem 7: at least 40 words, sets of three successive words, Jaccard similarity of 0.7.
_ALIKE = {"key": "id", "text": "original_text", "size": 3, "least_words": 40, "threshold": 0.7}


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every two turns whose texts are alike."""
    return neardup.similar_pairs(table(spark, folder, "turns"), **_ALIKE)


def p7_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn of 40 words or more with its class of equal sets, its group and the number of turns alike."""
    return neardup.groups(table(spark, folder, "turns"), **_ALIKE)


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of every document."""
    return tokens.encoded(table(spark, folder, "documents"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document is used, so that the sources hold their weights."""
    return mixture.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    """The shares reached beside the targets."""
    return mixture.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every two documents that look the same but aren't equal."""
    return lookalikes.pairs(table(spark, folder, "documents").select("doc_id", "text"))


def p10_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its text in one form."""
    return lookalikes.canonical(table(spark, folder, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (p1_found, p1_redacted, p2_found, p2_redacted, p5_found, p5_conversations, p7_found, p7_groups, p8_ids, p9_mix, p9_report, p10_found, p10_canonical)}
