"""Queries of plain expressions, of the read side and of the enrichment as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import shrink
from turnloom.functions import text as X
from turnloom.operators import analytics as A
from turnloom.operators import filters as P
from turnloom.operators import turns as T
from turnloom.operators.neighbours import running
from turnloom.plans import dashboards as _dashboards  # noqa: F401, I001  before the SQL that is made from its own
from turnloom.plans import edits, views
from turnloom.plans.registry import SQL, query
from turnloom.sources.tables import table


@query(f"SELECT session_row_id, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms, count(*) AS events FROM parsed_events WHERE {A.IN_MS} AND session_row_id IS NOT NULL GROUP BY 1")
def s47_event_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """The first and last time of each session's events."""
    return table(spark, folder, "parsed_events").where(f"{A.IN_MS} and session_row_id is not null").groupBy("session_row_id").agg(F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"), F.count(F.lit(1)).alias("events"))


@query("""WITH a AS (SELECT workspace_id, unnest(string_split(agent_used, '+')) AS agent FROM turns WHERE agent_used != '' UNION ALL SELECT workspace_id, unnest(string_split(agent_used, '+')) FROM workspace_info WHERE agent_used != '')
SELECT workspace_id, string_agg(DISTINCT agent, '+' ORDER BY agent) AS agents FROM a WHERE workspace_id IS NOT NULL AND agent != '' GROUP BY 1""")
def o12_workspace_agents(spark: SparkSession, folder: str) -> DataFrame:
    """The agents of each workspace, stored and seen, each once and sorted."""
    each = [table(spark, folder, t).where("agent_used != '' and workspace_id is not null").select("workspace_id", F.explode(F.split("agent_used", r"\+")).alias("agent")) for t in ("turns", "workspace_info")]
    distinct = each[0].unionByName(each[1]).where("agent != ''").distinct()
    return distinct.groupBy("workspace_id").agg(F.array_join(F.array_sort(F.collect_list("agent")), "+").alias("agents"))


@query(r"""SELECT file_id, coalesce(TRY_CAST(regexp_extract(cli_version, '^\s*([+-]?[0-9]+)', 1) AS BIGINT), 0) AS whole, coalesce(TRY_CAST(regexp_extract(cli_version, '^\s*([+-]?[0-9]+(?:\.[0-9]+)?)', 1) AS DOUBLE), 0) AS real FROM cli_session_files WHERE cli_version IS NOT NULL""")
def f05_lenient_casts(spark: SparkSession, folder: str) -> DataFrame:
    """the number that a text begins with, 0 without one."""
    v = F.col("cli_version")
    part = lambda pattern, kind: F.coalesce(F.regexp_extract(v, pattern, 1).try_cast(kind), F.lit(0).cast(kind))
    return table(spark, folder, "cli_session_files").where(v.isNotNull()).select("file_id", part(r"^\s*([+-]?[0-9]+)", "bigint").alias("whole"), part(r"^\s*([+-]?[0-9]+(?:\.[0-9]+)?)", "double").alias("real"))


@query("""SELECT id, CAST(json_object('role', lower(coalesce(role, '')), 'model', coalesce(nullif(model_id, ''), 'none'), 'turn', turn) AS VARCHAR) AS json, coalesce(session_name, '') || ' / ' || replace(coalesce(agent_used, '-'), '_', ' ') AS label, substr(original_text, 1, 20) AS head,
CASE WHEN agent_used LIKE 'copilot%' THEN 'copilot' WHEN agent_used IN ('claude', 'codex') THEN agent_used ELSE 'other' END AS family FROM turns WHERE turn IS NOT NULL""")
def f13_turn_labels(spark: SparkSession, folder: str) -> DataFrame:
    """JSON objects, concatenation, replacement, beginnings and cases."""
    agent = F.col("agent_used")
    json = F.to_json(F.struct(F.lower(F.coalesce("role", F.lit(""))).alias("role"), F.coalesce(F.nullif("model_id", F.lit("")), F.lit("none")).alias("model"), "turn"))
    label = F.concat(F.coalesce("session_name", F.lit("")), F.lit(" / "), F.replace(F.coalesce(agent, F.lit("-")), F.lit("_"), F.lit(" ")))
    family = F.when(agent.startswith("copilot"), "copilot").when(agent.isin("claude", "codex"), agent).otherwise("other")
    return table(spark, folder, "turns").where("turn is not null").select("id", json.alias("json"), label.alias("label"), F.substring("original_text", 1, 20).alias("head"), family.alias("family"))


@query(r"""SELECT workspace_id, coalesce(regexp_matches(regexp_replace(replace(workspace_folder, chr(92), '/'), '/+$', ''), '(?i)^$|^[a-z]:$|^(?:[a-z]:)?/(?:home|users)(?:/[^/]+)?$|^/root$|^/mnt/[a-z](?:/users(?:/[^/]+)?)?$'), false) AS wide, regexp_replace(workspace_folder, '[:/\\.]', '-', 'g') AS folder_id FROM workspace_info""")
def p12_wide_folders(spark: SparkSession, folder: str) -> DataFrame:
    """Folders that are too wide for a workspace, and the ids that logs are kept under."""
    f = F.col("workspace_folder")
    return table(spark, folder, "workspace_info").select("workspace_id", P.home_or_root(f).alias("wide"), X.folder_id(f).alias("folder_id"))


@query("""WITH s AS (SELECT t.session_id, count(*) AS turns, bool_or(p.parent_session_id IS NOT NULL) AS child, max(p.title) AS title FROM turns t LEFT JOIN parsed_sessions p ON p.session_id = t.session_id WHERE t.session_id IS NOT NULL GROUP BY 1)
SELECT session_id, turns, NOT child AND turns <= 1 AND coalesce(regexp_matches(lower(trim(title)), '^(?:caveat:|/clear$)'), false) AS bootstrap, NOT child AS top FROM s""")
def g15_visible_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions with their turns, whether they are children and whether they were only opened."""
    told = table(spark, folder, "parsed_sessions").select("session_id", "parent_session_id", "title")
    rows = table(spark, folder, "turns").where("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("turns")).join(told, "session_id", "left")
    return rows.select("session_id", "turns", P.bootstrap_only(F.col("turns"), F.col("parent_session_id"), F.col("title")).alias("bootstrap"), F.col("parent_session_id").isNull().alias("top"))


@query("""WITH t AS (SELECT workspace_id, count(*) AS turns, count(DISTINCT session_id) AS sessions, arg_max(workspace_folder, id) FILTER (workspace_folder IS NOT NULL) AS folder FROM turns WHERE workspace_id IS NOT NULL GROUP BY 1)
SELECT w.workspace_id, coalesce(nullif(w.workspace_folder, ''), t.folder) AS folder, coalesce(w.workspace_name, '') AS name, coalesce(t.sessions, 0) AS sessions, coalesce(t.turns, 0) AS turns, CASE WHEN t.turns IS NULL THEN 'empty' WHEN t.turns < coalesce(w.turn_count, 0) THEN 'partial' ELSE 'complete' END AS status FROM workspace_info w LEFT JOIN t ON t.workspace_id = w.workspace_id""")
def g13_workspaces(spark: SparkSession, folder: str) -> DataFrame:
    """All stored workspaces with their folder, what is there of them, and a status."""
    seen = table(spark, folder, "turns").where("workspace_id is not null").groupBy("workspace_id").agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("session_id").alias("sessions"), F.max_by("workspace_folder", F.when(F.col("workspace_folder").isNotNull(), F.col("id"))).alias("folder"))
    rows = table(spark, folder, "workspace_info").select("workspace_id", "workspace_folder", "workspace_name", "turn_count").join(seen, "workspace_id", "left")
    status = F.when(F.col("turns").isNull(), "empty").when(F.col("turns") < F.coalesce("turn_count", F.lit(0)), "partial").otherwise("complete")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("workspace_id", F.coalesce(F.nullif("workspace_folder", F.lit("")), "folder").alias("folder"), F.coalesce("workspace_name", F.lit("")).alias("name"), zero("sessions"), zero("turns"), status.alias("status"))


_ESTIMATE = "CASE WHEN coalesce(length({c}), 0) = 0 THEN 0 ELSE greatest(1, length({c}) // 4) END"


@query(f"""WITH s AS (SELECT id, CASE WHEN original_text_tokens > 0 THEN original_text_tokens ELSE {_ESTIMATE.format(c='original_text')} END AS source, coalesce(length(text), 0) AS short, coalesce(length(original_text), 0) AS long FROM turns)
SELECT id, source, CASE WHEN long = 0 THEN 0 ELSE least(CAST(floor(source * (short / long::DOUBLE)) AS BIGINT), source) END AS cleaned FROM s""")
def t13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A turn's tokens, stated or else estimated, and those of its cleaned text in proportion."""
    stated = F.when(F.col("original_text_tokens") > 0, F.col("original_text_tokens")).otherwise(X.tokens(F.col("original_text")))
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    share = F.floor(stated * (size("text") / size("original_text").cast("double"))).cast("bigint")
    return table(spark, folder, "turns").select("id", stated.alias("source"), F.when(size("original_text") == 0, F.lit(0).cast("bigint")).otherwise(F.least(share, stated)).alias("cleaned"))


@query("""SELECT id, CASE WHEN model_id != '' THEN model_id ELSE last_value(nullif(model_id, '') IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS model FROM turns WHERE session_id IS NOT NULL AND turn IS NOT NULL""")
def w17_filled_models(spark: SparkSession, folder: str) -> DataFrame:
    """The model of each turn, else that of the last turn before it in its session that has one."""
    rows = table(spark, folder, "turns").where("session_id is not null and turn is not null").select("id", "session_id", "turn", F.nullif("model_id", F.lit("")).alias("own"))
    rows = running(rows, "session_id", F.floor(F.col("turn") / T.SPAN), ["turn", "id"], maxes={"held": F.when(F.col("own").isNotNull(), F.struct("turn", "id", "own"))})
    return rows.select("id", F.coalesce("own", "held.own").alias("model"))


@query(f"""SELECT m.id, m.model_id, r.response_ms, h.history_tokens, k.cleaned, lower(regexp_extract(CASE WHEN files LIKE '[%' AND json_valid(files) THEN json_extract_string(files, '$[0]') END, '\\.([A-Za-z0-9]+)$', 1)) AS ending
FROM ({SQL['t14_default_models']}) m JOIN ({SQL['t_history_tokens']}) h ON h.id = m.id LEFT JOIN ({SQL['t_responses']}) r ON r.id = m.id JOIN ({SQL['t13_token_counts']}) k ON k.id = m.id JOIN turns t ON t.id = m.id""")
def t28_enriched_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The enrichment as a whole: models by default, response times, tokens before and within, the ending of the first file."""
    turns = table(spark, folder, "turns")
    first = F.get(A.text_list(F.col("files")), F.lit(0))
    own = turns.select("id", F.lower(F.regexp_extract(first, r"\.([A-Za-z0-9]+)$", 1)).alias("ending"))
    rows = edits.t14_default_models(spark, folder).join(T.history_tokens(turns).select("id", "history_tokens"), "id").join(T.responses(turns).select("id", "response_ms"), "id", "left")
    return rows.join(t13_token_counts(spark, folder).select("id", "cleaned"), "id").join(own, "id").select("id", "model_id", "response_ms", "history_tokens", "cleaned", "ending")


@query("""WITH f AS (SELECT DISTINCT json_extract_string(v, '$') AS p FROM (SELECT unnest(CAST(json_extract(files, '$[*]') AS JSON[])) AS v FROM turns WHERE files LIKE '[%' AND json_valid(files))) SELECT 'file:///' || replace(p, '_', '%5F') || '%20a+b' AS uri, '/' || p || ' a+b' AS path FROM f WHERE p != ''""")
def f30_file_uris(spark: SparkSession, folder: str) -> DataFrame:
    """paths of file URIs, percent signs read and plus signs kept."""
    files = table(spark, folder, "turns").select(F.explode(A.text_list(F.col("files"))).alias("p")).distinct()
    uri = files.select(F.concat(F.lit("file:///"), F.replace("p", F.lit("_"), F.lit("%5F")), F.lit("%20a+b")).alias("uri"))
    return uri.select("uri", X.uri_path(F.col("uri")).alias("path"))


@query(f"""WITH c AS ({SQL['a12_agent_distribution']}), b AS (SELECT agent FROM c WHERE agent IS NOT NULL ORDER BY turns DESC, agent LIMIT 15) SELECT CASE WHEN agent IN (SELECT agent FROM b) THEN agent ELSE 'others' END AS agent, CAST(sum(turns) AS BIGINT) AS turns FROM c WHERE agent IS NOT NULL GROUP BY 1""")
def e04_dashboard_part(spark: SparkSession, folder: str) -> DataFrame:
    """One part of a declared dashboard, by its id."""
    return views.part(spark, folder, "system", "agents")


@query()
def f46_shrunk_texts(spark: SparkSession, folder: str) -> DataFrame:
    """texts made short and without logs; no SQL, compared by hand in tests."""
    return table(spark, folder, "documents").select("doc_id", F.length(shrink.shrunk_column(F.col("text"))).alias("shrunk"), F.length(shrink.without_logs(F.col("text"))).alias("without_logs"))


@query()
def t11_edit_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Lines, branches and tokens before and after each edit; no SQL, compared by hand in tests."""
    rows = edits.t10_chained_edits(spark, folder)
    return rows.select("id", shrink.edit_metrics(F.col("before"), F.col("after")).alias("m")).select("id", "m.*")
