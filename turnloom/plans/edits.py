"""Queries of code edits, the index and what tables and charts do at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.dates import utc, utc_sql
from turnloom.functions.text import SPACE, digest
from turnloom.functions.vectors import dot
from turnloom.operators import enrich
from turnloom.operators import index as N
from turnloom.operators.adapter import code_edits
from turnloom.operators.analytics import IN_MS
from turnloom.plans.registry import query
from turnloom.sources.tables import table


_LINES = "CASE WHEN coalesce({c}, '') = '' THEN 0 ELSE len(string_split({c}, chr(10))) END"
_EDITS = """e AS (SELECT id, event_row_id, call_index, lower(name) AS name, CASE WHEN json_valid(arguments_json) THEN arguments_json END AS a, CASE WHEN json_valid(file_paths_json) THEN json_extract_string(file_paths_json, '$[0]') END AS p FROM parsed_tool_calls WHERE lower(name) IN ('write', 'edit')),
x AS (SELECT id, event_row_id, call_index, coalesce(nullif(p, ''), nullif(json_extract_string(a, '$.file_path'), ''), nullif(json_extract_string(a, '$.path'), '')) AS file, CASE WHEN name = 'edit' THEN json_extract_string(a, '$.old_string') END AS before, json_extract_string(a, CASE WHEN name = 'write' THEN '$.content' ELSE '$.new_string' END) AS after FROM e)"""


def _edits(spark: SparkSession, folder: str) -> DataFrame:
    calls = table(spark, folder, "parsed_tool_calls")
    lines = lambda c: F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.size(F.split(c, "\n"))).cast("bigint")
    rows = code_edits(calls.select("id", "name", F.col("arguments_json").alias("arguments"), F.col("file_paths_json").alias("file_paths"), F.col("raw_json").alias("raw")))
    return rows.select("id", "file", lines(F.col("after")).alias("lines_after"), lines(F.col("before")).alias("lines_before"))


@query(f"""WITH {_EDITS} SELECT id, file, {_LINES.format(c='after')} AS lines_after, {_LINES.format(c='before')} AS lines_before FROM x WHERE file IS NOT NULL""")
def t05_code_edits(spark: SparkSession, folder: str) -> DataFrame:
    """The edits that calls describe, with their lines before and after."""
    return _edits(spark, folder)


@query(f"""WITH {_EDITS}, q AS (SELECT r.request_id, x.id, x.event_row_id, x.call_index, file, {_LINES.format(c='after')} AS la, {_LINES.format(c='before')} AS lb FROM x JOIN parsed_events r ON r.id = x.event_row_id WHERE file IS NOT NULL AND r.request_id != ''),
g AS (SELECT request_id, count(*) AS edits, string_agg(file || ':' || lb || ':' || la, ',' ORDER BY event_row_id, call_index, id) AS list FROM q GROUP BY 1)
SELECT t.id, t.session_id, t.turn, t.request_id, g.edits, g.list FROM turns t JOIN g ON g.request_id = t.request_id WHERE t.role = 'assistant'""")
def g04_turn_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Each assistant turn with the edits of its request, in order as one list."""
    calls = table(spark, folder, "parsed_tool_calls").select("id", "event_row_id", "call_index")
    events = table(spark, folder, "parsed_events").where("request_id != ''").select(F.col("id").alias("event_row_id"), "request_id")
    edits = _edits(spark, folder).join(calls, "id").join(events, "event_row_id")
    item = F.struct("event_row_id", "call_index", "id", F.concat_ws(":", "file", F.col("lines_before").cast("string"), F.col("lines_after").cast("string")).alias("text"))
    lists = edits.groupBy("request_id").agg(F.count(F.lit(1)).alias("edits"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), ",").alias("list"))
    return table(spark, folder, "turns").where("role = 'assistant'").select("id", "session_id", "turn", "request_id").join(lists, "request_id").select("id", "session_id", "turn", "request_id", "edits", "list")


@query("""SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(string_split_regex(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda w: w != '')) AS term FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2""")
def k12_postings(spark: SparkSession, folder: str) -> DataFrame:
    """The inverted index of the documents."""
    return N.postings(table(spark, folder, "documents"))


@query("""SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(string_split_regex(strip_accents(lower(CASE WHEN source = 'session_log' THEN text ELSE title END)), '[^\\p{L}\\p{N}]+'), lambda w: w != '')) AS term FROM documents WHERE CASE WHEN source = 'session_log' THEN text ELSE title END IS NOT NULL) GROUP BY 1, 2""")
def k11_refreshed_postings(spark: SparkSession, folder: str) -> DataFrame:
    """The index of the titles, after the documents of one source have changed to their texts."""
    docs = table(spark, folder, "documents")
    return N.refreshed(N.postings(docs, text="title"), docs.where("source = 'session_log'").select("doc_id", "text"))


_BARE = f"regexp_replace(d.text, '^{SPACE}+|{SPACE}+$', '', 'g')"


@query(f"""SELECT d.doc_id, sha256({_BARE}) AS text_hash FROM documents d LEFT JOIN documents o ON o.doc_id = d.doc_id AND o.source = 'session_log' WHERE {_BARE} != '' AND o.doc_id IS NULL""")
def x05_stale_documents(spark: SparkSession, folder: str) -> DataFrame:
    """What has to be encoded when the documents of one source are up to date."""
    docs = table(spark, folder, "documents")
    stored = docs.where("source = 'session_log'").select("doc_id", digest(F.col("text")).alias("text_hash"))
    return N.stale(docs, stored).select("doc_id", "text_hash")


@query("""SELECT label, count(*) AS n, round(avg(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS norm FROM embeddings GROUP BY label""")
def r13_vector_norms(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors by label and their norms."""
    v = F.col("embedding")
    return table(spark, folder, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(dot(v, v)), 4).alias("norm"))


@query("""WITH t AS (SELECT CAST(coalesce(sum(total_code_loc), 0) AS BIGINT) AS loc FROM workspace_info), a AS (SELECT CAST(coalesce(sum(total_lines_added), 0) AS BIGINT) AS ai FROM turns) SELECT 'ai' AS part, least(ai, loc) AS lines FROM t, a UNION ALL SELECT 'other', greatest(0, loc - ai) FROM t, a""")
def a33_contribution(spark: SparkSession, folder: str) -> DataFrame:
    """Lines by assistants and by others."""
    total = table(spark, folder, "workspace_info").agg(F.coalesce(F.sum("total_code_loc"), F.lit(0)).alias("loc"))
    both = table(spark, folder, "turns").agg(F.coalesce(F.sum("total_lines_added"), F.lit(0)).alias("ai")).join(total)
    return both.selectExpr("stack(2, 'ai', least(ai, loc), 'other', greatest(0L, loc - ai)) as (part, lines)")


@query("""SELECT session_id, title, CAST(row_number() OVER (ORDER BY title IS NULL, lower(title), session_id) AS INTEGER) AS row FROM parsed_sessions WHERE contains(lower(coalesce(title, '') || ' ' || session_id), 'a') ORDER BY row LIMIT 50""")
def c06_sorted_table(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions that hold a text, sorted without regard to case, NULLs last, the first 50."""
    from turnloom.operators.charts import numbered
    from turnloom.session import cut_lineage

    held = table(spark, folder, "parsed_sessions").select("session_id", "title").where(F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), "session_id")).contains("a"))
    order = (F.lower("title").asc_nulls_last(), F.col("session_id"))
    return numbered(cut_lineage(held.orderBy(*order).limit(50)), *order)


_METRICS = f"""{_EDITS}, m AS (SELECT x.file, e.request_id, e.session_row_id, {_LINES.format(c='after')} AS added, {_LINES.format(c='before')} AS removed FROM x JOIN parsed_events e ON e.id = x.event_row_id WHERE file IS NOT NULL)"""


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    """(file, request_id, session_row_id, added, removed): the code metrics that edits give."""
    calls = table(spark, folder, "parsed_tool_calls").select("id", "event_row_id")
    events = table(spark, folder, "parsed_events").select(F.col("id").alias("event_row_id"), "request_id", "session_row_id")
    return _edits(spark, folder).join(calls, "id").join(events, "event_row_id").select("file", "request_id", "session_row_id", F.col("lines_after").alias("added"), F.col("lines_before").alias("removed"))


@query(f"WITH {_METRICS} SELECT file, count(DISTINCT request_id) AS requests, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed FROM m GROUP BY file ORDER BY requests DESC, added DESC, file LIMIT 50")
def a18_edit_hotspots(spark: SparkSession, folder: str) -> DataFrame:
    """The files that most requests change, of the metrics of edits."""
    per = _metrics(spark, folder).groupBy("file").agg(F.countDistinct("request_id").alias("requests"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))
    return per.orderBy(F.col("requests").desc(), F.col("added").desc(), "file").limit(50)


@query(f"WITH {_METRICS} SELECT s.session_id, m.file, count(*) AS edits, round(avg(added - removed), 3) AS net FROM m JOIN parsed_sessions s ON s.id = m.session_row_id GROUP BY 1, 2")
def a17_edit_evolution(spark: SparkSession, folder: str) -> DataFrame:
    """Edits and their average net lines per session and file."""
    sessions = table(spark, folder, "parsed_sessions").select(F.col("id").alias("session_row_id"), "session_id")
    return _metrics(spark, folder).join(sessions, "session_row_id").groupBy("session_id", "file").agg(F.count(F.lit(1)).alias("edits"), F.round(F.avg(F.col("added") - F.col("removed")), 3).alias("net"))


@query(f"""WITH {_METRICS}, r AS (SELECT t.model_id, m.added FROM m JOIN turns t ON t.request_id = m.request_id AND t.role = 'assistant' WHERE m.request_id != ''), k AS (SELECT coalesce(nullif(model_id, ''), 'unknown') AS model, CAST(sum(added) AS BIGINT) AS lines FROM r GROUP BY 1) SELECT model, lines FROM k WHERE lines > 0""")
def a32_model_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Added lines of the edits by the model of their request; models without any are left out."""
    turns = table(spark, folder, "turns").where("role = 'assistant' and request_id != ''").select("request_id", F.coalesce(F.nullif("model_id", F.lit("")), F.lit("unknown")).alias("model"))
    return _metrics(spark, folder).join(turns, "request_id").groupBy("model").agg(F.sum("added").alias("lines")).where("lines > 0")


@query("SELECT id, CAST(response_time_ms AS DOUBLE) AS x, CAST(weighted_complexity_change AS DOUBLE) AS y FROM turns WHERE response_time_ms IS NOT NULL AND weighted_complexity_change IS NOT NULL AND NOT isnan(weighted_complexity_change) AND NOT isinf(weighted_complexity_change)")
def c05_scatter(spark: SparkSession, folder: str) -> DataFrame:
    """Points with finite coordinates."""
    from turnloom.operators.charts import scatter

    return scatter(table(spark, folder, "turns"), "id", "response_time_ms", "weighted_complexity_change")


@query(r"""WITH q AS (SELECT id, trim(role || ': ' || chr(39) || regexp_replace(left(coalesce(original_text, ''), 80), '\s+', ' ', 'g') || chr(39)) AS v FROM turns WHERE role IS NOT NULL), p AS (SELECT id, v, regexp_matches(v, '(?i)^(user|assistant)\s*:\s*.+$') AS said, trim(regexp_replace(v, '(?i)^(user|assistant)\s*:\s*', '')) AS t FROM q)
SELECT id, CASE WHEN said THEN lower(regexp_extract(v, '(?i)^(user|assistant)', 1)) END AS speaker, CASE WHEN NOT said THEN v WHEN length(t) >= 2 AND left(t, 1) = right(t, 1) AND left(t, 1) IN (chr(39), '"') THEN trim(t[2:-2]) ELSE t END AS text FROM p""")
def c14_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """C14: quotes with their speaker, put together from the beginnings of turns."""
    from turnloom.operators.charts import quoted

    line = F.concat(F.col("role"), F.lit(": '"), F.regexp_replace(F.left(F.coalesce("original_text", F.lit("")), F.lit(80)), r"\s+", " "), F.lit("'"))
    return table(spark, folder, "turns").where("role is not null").select("id", quoted(line).alias("q")).select("id", "q.speaker", "q.text")


@query(f"""WITH {_EDITS}, c AS (SELECT x.id, s.session_id, x.file, CASE WHEN e.{IN_MS} THEN e.timestamp_ms ELSE 0 END AS ms, nullif(x.before, '') AS before, nullif(x.after, '') AS after FROM x JOIN parsed_events e ON e.id = x.event_row_id JOIN parsed_sessions s ON s.id = e.session_row_id WHERE x.file IS NOT NULL),
l AS (SELECT *, lag(after) OVER (PARTITION BY session_id, file ORDER BY ms, id) AS earlier FROM c)
SELECT id, session_id, file, CASE WHEN coalesce(before, '') = '' THEN coalesce(earlier, before) ELSE before END AS before, after FROM l""")
def t10_chained_edits(spark: SparkSession, folder: str) -> DataFrame:
    """An edit that doesn't say what it found takes what the edit before it left in the same file of its session."""
    calls = table(spark, folder, "parsed_tool_calls")
    edits = code_edits(calls.select("id", "name", F.col("arguments_json").alias("arguments"), F.col("file_paths_json").alias("file_paths"), F.lit(None).cast("string").alias("raw")))
    events = table(spark, folder, "parsed_events").select(F.col("id").alias("event_row_id"), "session_row_id", F.when(F.expr(IN_MS), F.col("timestamp_ms")).otherwise(0).alias("at"))
    sessions = table(spark, folder, "parsed_sessions").select(F.col("id").alias("session_row_id"), "session_id")
    rows = edits.join(calls.select("id", "event_row_id"), "id").join(events, "event_row_id").join(sessions, "session_row_id")
    # one workspace and agent here: the session tells both
    keyed = rows.select(F.lit("").alias("workspace"), F.lit("").alias("agent"), F.col("session_id").alias("session"), "file", "at", F.col("id").alias("ord"), F.nullif("before", F.lit("")).alias("before"), F.nullif("after", F.lit("")).alias("after"))
    made = enrich.chained_edits(keyed)
    return made.select(F.col("ord").alias("id"), F.col("session").alias("session_id"), "file", F.nullif("before", F.lit("")).alias("before"), "after")


@query(f"""WITH d AS (SELECT id, agent_used AS agent, model_id, CAST({utc_sql('timestamp_iso')} AS DATE) AS day FROM turns WHERE agent_used IS NOT NULL AND {utc_sql('timestamp_iso')} IS NOT NULL),
m AS (SELECT agent, model_id, min(day) AS since FROM d WHERE model_id != '' GROUP BY 1, 2), t AS (SELECT agent, since, max(model_id) AS model FROM m GROUP BY 1, 2)
SELECT d.id, CASE WHEN coalesce(d.model_id, '') = '' THEN coalesce(t.model, d.model_id) ELSE d.model_id END AS model_id FROM d ASOF LEFT JOIN t ON d.agent = t.agent AND d.day >= t.since""")
def t14_default_models(spark: SparkSession, folder: str) -> DataFrame:
    """Turns without a model take the agent's latest one up to their day, of a timeline of first uses."""
    turns = table(spark, folder, "turns").where("agent_used is not null").select("id", F.col("agent_used").alias("agent"), F.to_date(utc(F.col("timestamp_iso"))).alias("day"), "model_id").where("day is not null")
    uses = turns.where("model_id != ''").groupBy("agent", "model_id").agg(F.min("day").alias("since"))
    return enrich.defaulted_models(turns, uses.groupBy("agent", "since").agg(F.max("model_id").alias("model"))).select("id", "model_id")
