"""Queries of filters, identities and the read side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.operators import filters as P
from turnloom.plans.registry import query
from turnloom.sources.tables import table


@query("""SELECT count(*) FILTER (lower(coalesce(role, '')) IN ('user', 'assistant')) AS spoken, count(*) FILTER (lower(coalesce(agent_used, '')) = 'copilot') AS equal, count(*) FILTER (contains(lower(coalesce(agent_used, '')), 'copilot')) AS containing,
count(*) FILTER (files IS NOT NULL AND files NOT IN ('', '[]')) AS with_files, count(*) FILTER (coalesce(total_lines_added, 0) > 0 OR coalesce(total_lines_removed, 0) > 0) AS with_code, count(*) FILTER (coalesce(regexp_full_match(session_id, '[A-Za-z0-9_-]+'), false)) AS valid_ids FROM turns""")
def filter_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that each predicate keeps, in one pass."""
    kept = {"spoken": P.has_role(["User", "assistant"]), "equal": P.of_agent("copilot"), "containing": P.of_agent("Copilot", "contains"), "with_files": P.given("files", ("", "[]")), "with_code": P.changes_code(), "valid_ids": P.valid_session_id(F.col("session_id"))}
    return table(spark, folder, "turns").agg(*[F.count_if(c).alias(n) for n, c in kept.items()])


@query("""WITH f AS (SELECT workspace_folder AS f FROM turns WHERE workspace_folder IS NOT NULL ORDER BY id LIMIT 1) SELECT t.id FROM turns t, f WHERE lower(replace(t.workspace_folder, chr(92), '/')) = lower(replace(f.f, chr(92), '/'))""")
def filter_scope(spark: SparkSession, folder: str) -> DataFrame:
    """The turns of one workspace folder, that of the first turn."""
    turns = table(spark, folder, "turns")
    first = turns.where("workspace_folder is not null").orderBy("id").limit(1).select(P.plain_folder(F.col("workspace_folder")).alias("first_"))
    return turns.select("id", P.plain_folder(F.col("workspace_folder")).alias("folder_")).join(F.broadcast(first), F.col("folder_") == F.col("first_")).select("id")


@query("""SELECT CASE WHEN coalesce(s, '') != '' THEN 'folder:' || s ELSE 'id:' || workspace_id END AS identity, count(*) AS rows, arg_min(workspace_id, struct_pack(n := length(workspace_id), i := workspace_id)) AS workspace_id, CAST(sum(coalesce(session_count, 0)) AS BIGINT) AS sessions
FROM (SELECT *, lower(regexp_replace(replace(workspace_folder, chr(92), '/'), '/+$', '')) AS s FROM workspace_info) GROUP BY 1""")
def g12_workspace_identities(spark: SparkSession, folder: str) -> DataFrame:
    """Workspaces that are one by folder, under the shortest id."""
    rows = table(spark, folder, "workspace_info").groupBy(X.identity(F.col("workspace_folder"), F.col("workspace_id")).alias("identity"))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.min_by("workspace_id", F.struct(F.length("workspace_id"), F.col("workspace_id"))).alias("workspace_id"), F.coalesce(F.sum("session_count"), F.lit(0)).cast("bigint").alias("sessions"))


@query("""SELECT t.id, coalesce(c.calls, 0) AS calls, coalesce(c.failed, 0) AS failed, c.names AS names FROM turns t LEFT JOIN (SELECT session_id, turn, count(*) AS calls, count(*) FILTER (status = 'error') AS failed, string_agg(name, ',' ORDER BY tool_index, id) AS names FROM turn_tool_calls GROUP BY 1, 2) c ON c.session_id = t.session_id AND c.turn = t.turn""")
def g01_turns_with_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn with its tool calls in order; the list of a turn is as long as its calls."""
    calls = table(spark, folder, "turn_tool_calls").groupBy("session_id", "turn").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") == "error").alias("failed"), F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("tool_index", "id", "name")))).alias("list"))
    rows = table(spark, folder, "turns").select("id", "session_id", "turn").join(calls, ["session_id", "turn"], "left")
    names = F.array_join(F.transform("list", lambda x: x["name"]), ",")
    return rows.select("id", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("failed", F.lit(0)).alias("failed"), F.nullif(names, F.lit("")).alias("names"))


@query("""SELECT id, CASE WHEN length(s) > 160 THEN substr(s, 1, 160) || '...' ELSE s END AS snippet FROM (SELECT id, regexp_replace(original_text, '[\\r\\n]+', ' ', 'g') AS s FROM turns)""")
def r15_snippets(spark: SparkSession, folder: str) -> DataFrame:
    """A line of each turn's text."""
    return table(spark, folder, "turns").select("id", X.snippet(F.col("original_text")).alias("snippet"))


@query("""SELECT session_id, count(*) AS children FROM (SELECT parent_session_id AS session_id FROM parsed_sessions WHERE parent_session_id IS NOT NULL AND parent_session_id != session_id) GROUP BY 1""")
def g09_child_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Children of each parent session."""
    return table(spark, folder, "parsed_sessions").where("parent_session_id != session_id").groupBy(F.col("parent_session_id").alias("session_id")).agg(F.count(F.lit(1)).alias("children"))


@query("""SELECT e.id AS event_id, count(b.id) AS blocks, count(b.id) FILTER (b.kind = 'text') AS texts, coalesce(string_agg(b.text, chr(10) ORDER BY b.block_index, b.id) FILTER (b.kind = 'text' AND b.text IS NOT NULL AND b.text != ''), '') AS text FROM parsed_events e LEFT JOIN parsed_content_blocks b ON b.event_row_id = e.id GROUP BY e.id""")
def t04_display_text(spark: SparkSession, folder: str) -> DataFrame:
    """The text of each event put together from its text blocks in order."""
    shown = (F.col("kind") == "text") & F.col("text").isNotNull() & (F.col("text") != "")
    blocks = table(spark, folder, "parsed_content_blocks").groupBy("event_row_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("kind") == "text").alias("texts"), F.array_sort(F.collect_list(F.when(shown, F.struct("block_index", "id", "text")))).alias("list"))
    rows = table(spark, folder, "parsed_events").select(F.col("id").alias("event_id")).join(blocks, F.col("event_id") == F.col("event_row_id"), "left")
    return rows.select("event_id", F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce(F.array_join(F.transform("list", lambda x: x["text"]), "\n"), F.lit("")).alias("text"))


@query("""SELECT kind, status, count(*) AS calls FROM (SELECT kind, CASE WHEN status IS NOT NULL AND status != '' AND status != 'unknown' THEN status WHEN json_valid(results_json) AND results_json LIKE '[{%' THEN CASE WHEN json_extract_string(results_json, '$[0].is_error') = 'true' THEN 'error' ELSE 'success' END ELSE 'unknown' END AS status FROM turn_tool_calls) GROUP BY 1, 2""")
def t20_call_statuses(spark: SparkSession, folder: str) -> DataFrame:
    """Calls by kind and status, derived from the first result where none is stated."""
    from turnloom.operators.analytics import given

    results = F.col("results_json")
    valid = F.try_parse_json(results).isNotNull() & results.startswith("[{")
    derived = F.when(valid, F.when(F.get_json_object(results, "$[0].is_error") == "true", "error").otherwise("success")).otherwise("unknown")
    status = F.when(given("status") & (F.col("status") != "unknown"), F.col("status")).otherwise(derived)
    return table(spark, folder, "turn_tool_calls").groupBy("kind", status.alias("status")).agg(F.count(F.lit(1)).alias("calls"))
