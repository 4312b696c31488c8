"""Queries of the general training-data problems: 3, 4 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators import drift, nesting, timestamps
from turnloom.sources.tables import table


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """each row of turns with a readable time and its instant."""
    turns = table(spark, folder, "turns").select("id", "session_id", "timestamp_ms", "timestamp_iso", "ts")
    sessions = table(spark, folder, "parsed_sessions").select("session_id", "metadata_json")
    return timestamps.normalise_times(turns, sessions).where(F.col("utc_ms").isNotNull())


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "cli_session_files").select("file_id", "install_id", "rel_path", "written_at", "payload")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each change of the message records from one file of an install to the next."""
    return drift.changes(_files(spark, folder))


def p3_messages(spark: SparkSession, folder: str) -> DataFrame:
    """All messages of all files in one table, under one set of names."""
    return drift.unified(_files(spark, folder))


def p3_names(spark: SparkSession, folder: str) -> DataFrame:
    """The names that the migration steps make one."""
    return drift.canonical_names(_files(spark, folder))


def p3_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The schemas of each install in order, with their fingerprints."""
    return drift.versions(_files(spark, folder)).withColumn("fields", F.to_json("fields"))


def p3_steps(spark: SparkSession, folder: str) -> DataFrame:
    """The migration steps from each version of an install's schema to the next."""
    return drift.steps(_files(spark, folder))


def p3_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The rename and cast rule of each field."""
    return drift.rules(_files(spark, folder))


#: The columns of problem 4, by table.
NESTED = (("parsed_content_blocks", "raw_json"), ("parsed_tool_calls", "arguments_json"), ("turn_tool_calls", "results_json"))


def nested_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(src, row_id, text) of all columns of problem 4."""
    parts = [table(spark, folder, t).select(F.lit(t).alias("src"), F.col("id").alias("row_id"), F.col(c).alias("text")) for t, c in NESTED]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each object that is an element of an array, with the nearest such object around it."""
    bridge = nesting.occurrences(nested_documents(spark, folder), bodies=False)
    return bridge.where("in_array").select("src", "row_id", "node", "parent")


def p4_bridge(spark: SparkSession, folder: str) -> DataFrame:
    """Parent-child rows between objects, by their Merkle ids, with path and ordinal."""
    return nesting.occurrences(nested_documents(spark, folder), bodies=False)


def p4_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct object once, with the number of its occurrences."""
    return nesting.objects(nesting.occurrences(nested_documents(spark, folder)))


QUERIES = {"p3_found": p3_found, "p3_messages": p3_messages, "p3_names": p3_names, "p3_versions": p3_versions, "p3_steps": p3_steps, "p3_rules": p3_rules, "p4_found": p4_found, "p4_bridge": p4_bridge, "p4_objects": p4_objects, "p6_found": p6_found}
