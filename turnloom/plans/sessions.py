"""Queries of conversations made from events, tool and subagent rows, forks and roll-ups by workspace.

The events are the rows of turns: user rows without text stand for results of tools, rows of other roles count where
they name tools, and texts may hold the marks of local commands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.text import SPACE, trimmed
from turnloom.operators import adapter, enrich
from turnloom.operators import analytics as A
from turnloom.plans.dashboards import _DAYS, _STOP, _TOKENS, STOP_WORDS
from turnloom.plans.registry import query
from turnloom.sources.tables import table


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of turns as events (adapter.EVENT)."""
    role = F.lower(F.trim("role"))
    none = lambda kind: F.lit(None).cast(kind)
    blank = F.coalesce(trimmed(F.col("original_text")), F.lit("")) == ""
    return table(spark, folder, "turns").select(
        F.col("session_id").alias("session"), F.col("turn").cast("bigint").alias("event_index"), "id", F.when(role.isin("user", "assistant"), role).otherwise("other").alias("role"), F.col("original_text").alias("text"), F.lit(True).alias("is_meta"),
        adapter.command_of(F.col("original_text"))["name"].alias("command"), none("string").alias("command_text"), F.when(blank, F.array(F.lit("tool_result"))).alias("block_kinds"), none("array<string>").alias("block_texts"), A.given("tools").alias("has_results"),
        "thinking_text", F.when(F.expr(A.IN_MS), F.col("timestamp_ms")).alias("timestamp_ms"), "timestamp_iso", "request_id", "model_id", A.text_list(F.col("files")).alias("file_paths"), A.text_list(F.col("tools")).alias("tool_names"),
        F.col("original_text_tokens").alias("input_tokens"), F.col("code_tokens").alias("output_tokens"), none("bigint").alias("cache_read_tokens"), none("bigint").alias("cache_creation_tokens"),
    )


_LIST = "list_filter(list_transform(TRY_CAST(json_extract(CASE WHEN {c} LIKE '[%' AND json_valid({c}) THEN {c} END, '$[*]') AS JSON[]), lambda v: CASE WHEN json_type(v) = 'OBJECT' THEN json_extract_string(v, '$.name') ELSE json_extract_string(v, '$') END), lambda x: x IS NOT NULL AND x != '')"
_OVER = "(PARTITION BY session ORDER BY event_index, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_CONVERSATION = f"""e AS (SELECT session_id AS session, CAST(turn AS BIGINT) AS event_index, id, CASE WHEN lower(trim(role)) IN ('user', 'assistant') THEN lower(trim(role)) ELSE 'other' END AS role, original_text AS text, coalesce(regexp_replace(original_text, '^{SPACE}+|{SPACE}+$', '', 'g'), '') = '' AS blank,
  lower(coalesce(original_text, '')) AS low, tools IS NOT NULL AND tools != '' AS results, request_id, model_id, thinking_text, CASE WHEN {A.IN_MS} THEN timestamp_ms END AS ms, timestamp_iso AS iso, {_LIST.format(c='files')} AS files, {_LIST.format(c='tools')} AS tools, original_text_tokens AS tin, code_tokens AS tout
  FROM turns WHERE session_id IS NOT NULL AND turn IS NOT NULL),
f AS (SELECT *, CASE WHEN role = 'other' THEN CASE WHEN results THEN 'follow' END WHEN role = 'assistant' THEN 'assistant' WHEN contains(low, '<local-command-caveat>') THEN 'caveat'
  WHEN regexp_matches(low, '<command-name>\\s*/*(clear|effort)\\s*</command-name>') THEN NULL WHEN regexp_matches(low, '^\\s*<local-command-std(out|err)>') THEN 'output' WHEN blank THEN 'follow' ELSE 'user' END AS what FROM e),
g AS (SELECT *, last_value(CASE WHEN what IN ('caveat', 'user') THEN what END IGNORE NULLS) OVER {_OVER} AS mark FROM f WHERE what IS NOT NULL),
h AS (SELECT * REPLACE (CASE WHEN what = 'output' THEN 'user' ELSE what END AS what) FROM g WHERE what != 'caveat' AND NOT (what = 'output' AND coalesce(mark = 'caveat', false))),
i AS (SELECT *, coalesce(bool_or(what = 'user') OVER {_OVER}, false) AS seen FROM h),
j AS (SELECT *, lag(what) OVER (PARTITION BY session ORDER BY event_index, id) AS before FROM i WHERE what = 'user' OR seen),
kept AS (SELECT *, what = 'follow' AS follow_up FROM j WHERE what != 'follow' OR before = 'assistant')"""


@query(f"WITH {_CONVERSATION} SELECT id, role, follow_up FROM kept")
def p09_conversation_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events that belong to conversations, and which of them are results that go with the event before."""
    return adapter.conversation_events(_events(spark, folder)).select("id", "role", "follow_up")


@query(f"""WITH {_CONVERSATION}, l AS (SELECT *, last_value(CASE WHEN NOT follow_up THEN role END IGNORE NULLS) OVER {_OVER} AS spoke FROM kept),
m AS (SELECT *, CAST(sum(CASE WHEN follow_up THEN 0 WHEN spoke IS NULL OR spoke != role THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY event_index, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS BIGINT) AS turn FROM l)
SELECT session, turn, min(role) FILTER (NOT follow_up) AS role, regexp_replace(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY event_index, id) FILTER (NOT follow_up AND text != ''), ''), '^{SPACE}+|{SPACE}+$', '', 'g') AS text,
  min(ms) FILTER (NOT follow_up) AS timestamp_ms, coalesce(arg_min(request_id, struct_pack(a := event_index, b := id)) FILTER (request_id != ''), '') AS request_id, count(DISTINCT request_id) FILTER (request_id != '') AS requests,
  coalesce(arg_min(model_id, struct_pack(a := event_index, b := id)) FILTER (model_id != ''), '') AS model_id, array_to_string(list_sort(list_distinct(flatten(coalesce(list(files) FILTER (files IS NOT NULL), [])))), ',') AS files, array_to_string(list_sort(list_distinct(flatten(coalesce(list(tools) FILTER (NOT follow_up AND tools IS NOT NULL), [])))), ',') AS tools,
  count(*) AS events, nullif(concat_ws(',', CASE WHEN sum(tin) != 0 THEN '"input_tokens":' || CAST(sum(tin) AS BIGINT) END, CASE WHEN sum(tout) != 0 THEN '"output_tokens":' || CAST(sum(tout) AS BIGINT) END), '') AS usage FROM m GROUP BY session, turn""")
def t01_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring events of one role put together as turns, results with the turn before."""
    rows = adapter.turns_of(_events(spark, folder))
    usage = F.regexp_replace("token_usage", r"^\{|\}$", "")
    return rows.select("session", "turn", "role", "text", "timestamp_ms", "request_id", F.size("request_ids").cast("bigint").alias("requests"), "model_id", F.array_join("files", ",").alias("files"), F.array_join("tools", ",").alias("tools"), "events", usage.alias("usage"))


_RESULT = "array<struct<tool_call_id:string,status:string,is_error:boolean>>"


@query("""WITH c AS (SELECT id, session_id, turn, coalesce(call_id, '') AS call_id, row_number() OVER (PARTITION BY session_id, turn ORDER BY tool_index, id) AS pos FROM turn_tool_calls WHERE session_id IS NOT NULL AND turn IS NOT NULL),
x AS (SELECT id, session_id, turn, tool_index, unnest(range(len(l))) AS n, unnest(l) AS v FROM (SELECT *, TRY_CAST(json_extract(results_json, '$[*]') AS JSON[]) AS l FROM turn_tool_calls WHERE session_id IS NOT NULL AND turn IS NOT NULL AND results_json LIKE '[%' AND json_valid(results_json))),
r AS (SELECT session_id, turn, row_number() OVER (PARTITION BY session_id, turn ORDER BY tool_index, id, n) AS result_index, CASE WHEN n % 3 = 0 THEN coalesce(json_extract_string(v, '$.tool_call_id'), '') ELSE '' END AS call_id, nullif(json_extract_string(v, '$.status'), 'unknown') AS status, json_extract_string(v, '$.is_error') = 'true' AS failed FROM x WHERE json_type(v) = 'OBJECT'),
o AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY result_index) AS pos FROM r WHERE call_id = ''),
m AS (SELECT c.id, r.result_index, r.status, r.failed FROM c JOIN r ON r.session_id = c.session_id AND r.turn = c.turn AND r.call_id = c.call_id AND c.call_id != ''),
p AS (SELECT c.id, o.result_index, o.status, o.failed FROM c JOIN o ON o.session_id = c.session_id AND o.turn = c.turn AND o.pos = c.pos WHERE c.id NOT IN (SELECT id FROM m)),
a AS (SELECT id, count(*) AS n, arg_min(nullif(status, ''), result_index) FILTER (status != '') AS stated, bool_or(coalesce(failed, false)) AS failed FROM (FROM m UNION ALL FROM p) GROUP BY id)
SELECT c.id, coalesce(n, 0) AS results, CASE WHEN stated IS NOT NULL THEN stated WHEN failed THEN 'error' WHEN n > 0 THEN 'success' ELSE 'unknown' END AS status FROM c LEFT JOIN a ON a.id = c.id""")
def t18_tool_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Calls with their results by id, else by position, and the status that follows. Every result but each third loses its id here, so that positions count."""
    rows = table(spark, folder, "turn_tool_calls").where("session_id is not null and turn is not null").select("id", F.struct("session_id", "turn").alias("event"), "tool_index", F.coalesce("call_id", F.lit("")).alias("call_id"), "results_json")
    items = F.from_json(F.when(F.col("results_json").startswith("[") & F.try_parse_json("results_json").isNotNull(), F.col("results_json")), "array<string>")
    each = rows.select("event", "id", "tool_index", F.posexplode(items).alias("n", "text")).where(F.col("text").startswith("{"))
    of = lambda k: F.get_json_object("text", f"$.{k}")
    results = each.select("event", F.struct("tool_index", "id", "n").alias("result_index"), F.when(F.col("n") % 3 == 0, F.coalesce(of("tool_call_id"), F.lit(""))).otherwise("").alias("call_id"), of("status").alias("status"), (of("is_error") == "true").alias("is_error"))
    made = enrich.matched_results(rows.select("event", F.struct("tool_index", "id").alias("call_index"), "call_id"), results)
    return made.select(F.col("call_index.id").alias("id"), "results", "status")


@query(f"""WITH p AS (SELECT session_id AS child, parent_session_id AS parent, started_at_ms AS started, relationship_type AS kind FROM parsed_sessions WHERE parent_session_id != ''),
t AS (SELECT session_id, turn, CASE WHEN {A.IN_MS} THEN timestamp_ms END AS ms FROM turns WHERE role = 'assistant' AND session_id IS NOT NULL AND turn IS NOT NULL),
i AS (SELECT child, parent, started, kind, (SELECT arg_max(t.turn, struct_pack(a := t.ms, b := t.turn)) FROM t WHERE t.session_id = parent AND t.ms <= started) AS near_turn, (SELECT arg_max(t.turn, struct_pack(a := coalesce(t.ms, 0), b := t.turn)) FROM t WHERE t.session_id = parent) AS last_turn FROM p),
s AS (SELECT session_id AS parent, spawned_session_id AS child, arg_max(turn, struct_pack(a := turn, b := tool_index)) AS told FROM turn_tool_calls WHERE spawned_session_id != '' GROUP BY 1, 2),
x AS (SELECT i.parent AS session, coalesce(told, near_turn, last_turn) AS turn, i.child, i.started, CASE WHEN told IS NOT NULL THEN 'subagent' ELSE coalesce(nullif(kind, ''), 'subagent') END AS relationship_type FROM i LEFT JOIN s ON s.parent = i.parent AND s.child = i.child)
SELECT session, turn, child, relationship_type, CAST(row_number() OVER (PARTITION BY session, turn ORDER BY coalesce(started, 0), child) - 1 AS INTEGER) AS subagent_index FROM x WHERE turn IS NOT NULL""")
def t19_subagent_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The turn that started each child session, told by a call or inferred from the times."""
    children = table(spark, folder, "parsed_sessions").select(F.col("session_id").alias("child"), F.col("parent_session_id").alias("parent_session"), F.col("started_at_ms").alias("started"), "relationship_type")
    turns = table(spark, folder, "turns").where("role = 'assistant' and session_id is not null and turn is not null").select(F.col("session_id").alias("session"), "turn", F.when(F.expr(A.IN_MS), F.col("timestamp_ms")).alias("at"))
    calls = table(spark, folder, "turn_tool_calls").select(F.col("session_id").alias("session"), "turn", F.col("tool_index").alias("call_index"), "call_id", "name", F.col("spawned_session_id").alias("spawned"))
    links = spark.createDataFrame([], "session string, turn int, link_index int, target string, call_id string, name string")
    return enrich.subagent_rows(children, turns, calls, links).select("session", "turn", "child", "relationship_type", "subagent_index")


@query()
def t24_branches(spark: SparkSession, folder: str) -> DataFrame:
    """The branches of each session, a turn's parent being the turn that it responds to, else the one before it; no SQL, compared with a walk in tests."""
    rows = table(spark, folder, "turns").where("session_id is not null and turn is not null").groupBy("session_id", "turn").agg(F.min_by(F.struct("role", "responding_to_turn"), "id").alias("r"))
    parent = F.when(F.col("turn") > 0, F.coalesce("r.responding_to_turn", F.col("turn") - 1).cast("string"))
    return enrich.split_forks(rows.select("session_id", F.col("turn").cast("string").alias("message_id"), parent.alias("parent_id"), F.col("r.role").alias("event_type"), F.col("turn").alias("event_index")))


@query(f"SELECT workspace_id, day, CAST(coalesce(sum(total_lines_added), 0) AS BIGINT) AS added, CAST(coalesce(sum(total_lines_removed), 0) AS BIGINT) AS removed FROM {_DAYS} WHERE workspace_id IS NOT NULL GROUP BY 1, 2")
def a34_workspace_timelines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines added and removed per workspace and day."""
    return A.per_day(table(spark, folder, "turns").where("workspace_id is not null")).groupBy("workspace_id", "day").agg(A.whole_sum("total_lines_added").alias("added"), A.whole_sum("total_lines_removed").alias("removed"))


@query(f"""WITH c AS (SELECT workspace_id, word, count(*) AS rows FROM ({_TOKENS.format(c='text', more=', workspace_id', t='turns')}) WHERE workspace_id IS NOT NULL AND length(word) >= 3 AND word NOT IN ({_STOP}) GROUP BY 1, 2)
SELECT workspace_id, word, rows, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY rows DESC, word) AS rank FROM c) WHERE rank <= 50""")
def a38_workspace_words(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 most frequent words of each workspace."""
    found = table(spark, folder, "turns").where("workspace_id is not null").select("workspace_id", F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[a-z][a-z0-9_]+"), F.lit(0))).alias("word"))
    counts = found.where((F.length("word") >= 3) & ~F.col("word").isin(*STOP_WORDS)).groupBy("workspace_id", "word").agg(F.count(F.lit(1)).alias("rows"))
    return A.ranked(counts, "workspace_id", "rows", 50, "word")


@query("""SELECT workspace_id, median_ms, CAST(CASE WHEN median_ms > 0 THEN greatest(60000, least(3600000, median_ms * 10)) ELSE 600000 END AS BIGINT) AS cap_ms FROM
(SELECT workspace_id, coalesce(CAST(floor(median(response_time_ms)) AS BIGINT), 0) AS median_ms FROM turns WHERE role = 'assistant' AND response_time_ms > 0 AND workspace_id IS NOT NULL GROUP BY 1)""")
def a40_workspace_caps(spark: SparkSession, folder: str) -> DataFrame:
    """The median response and the cap made from it, per workspace."""
    return A.response_caps(table(spark, folder, "turns").where("workspace_id is not null"), "workspace_id")


@query(f"""WITH cap AS (SELECT workspace_id, CAST(CASE WHEN m > 0 THEN greatest(60000, least(3600000, m * 10)) ELSE 600000 END AS BIGINT) AS cap_ms FROM (SELECT workspace_id, coalesce(CAST(floor(median(response_time_ms) FILTER (role = 'assistant' AND response_time_ms > 0)) AS BIGINT), 0) AS m FROM turns WHERE workspace_id IS NOT NULL GROUP BY 1))
SELECT a.workspace_id, count(*) AS turns, CAST(sum(CASE WHEN a.timestamp_ms > u.timestamp_ms AND a.timestamp_ms - u.timestamp_ms <= cap_ms THEN a.timestamp_ms - u.timestamp_ms ELSE 60000 END) AS BIGINT) AS total_ms
FROM turns a JOIN turns u ON u.session_id = a.session_id AND u.turn = a.responding_to_turn AND u.workspace_id = a.workspace_id AND u.role = 'user' JOIN cap ON cap.workspace_id = a.workspace_id WHERE a.role = 'assistant' AND a.{A.IN_MS} AND u.{A.IN_MS} GROUP BY 1""")
def a39_workspace_agentic_time(spark: SparkSession, folder: str) -> DataFrame:
    """Capped time between users' turns and the replies, per workspace with its own cap."""
    return A.agentic_time_within(table(spark, folder, "turns").where("workspace_id is not null"), "workspace_id")
