"""Queries of joins, search, charts and the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.dates import utc_sql
from turnloom.operators import analytics as A
from turnloom.operators import charts as C
from turnloom.operators import search as S
from turnloom.operators import store
from turnloom.operators.neighbours import running
from turnloom.plans.registry import query
from turnloom.sources.tables import table

_DAY = f"CAST({utc_sql('timestamp_iso')} AS DATE)"


@query("""SELECT e.event_id, v.event_id AS view_id FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts >= v.ts WHERE e.event_type = 'purchase'""")
def j14_asof(spark: SparkSession, folder: str) -> DataFrame:
    """For each purchase the last view of its user up to then, as a running maximum by day."""
    seen = F.when(F.col("event_type") == "view", F.struct("ts", "event_id"))
    rows = running(table(spark, folder, "events").where("event_type in ('view', 'purchase')").select("event_id", "user_id", "ts", "event_type", F.when(F.col("event_type") == "view", 0).otherwise(1).alias("late")), "user_id", F.to_date("ts"), ["ts", "late", "event_id"], maxes={"view": seen})
    return rows.where("event_type = 'purchase'").select("event_id", F.col("view.event_id").alias("view_id"))


@query("""SELECT coalesce(w.workspace_id, t.workspace_id) AS workspace_id, w.workspace_id IS NULL AS only_turns, t.workspace_id IS NULL AS only_stored, coalesce(w.turn_count, 0) AS stored_turns, coalesce(t.n, 0) AS actual_turns, greatest(0, coalesce(t.n, 0) - coalesce(w.turn_count, 0)) AS missing
FROM workspace_info w FULL JOIN (SELECT workspace_id, count(*) AS n FROM turns WHERE workspace_id IS NOT NULL GROUP BY 1) t ON w.workspace_id = t.workspace_id""")
def j19_sync_status(spark: SparkSession, folder: str) -> DataFrame:
    """Stored against actual counts, a full outer join."""
    t = table(spark, folder, "turns").where("workspace_id is not null").groupBy(F.col("workspace_id").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    w = table(spark, folder, "workspace_info").select("workspace_id", "turn_count")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return w.join(t, F.col("workspace_id") == F.col("t"), "full").select(F.coalesce("workspace_id", "t").alias("workspace_id"), F.col("workspace_id").isNull().alias("only_turns"), F.col("t").isNull().alias("only_stored"), zero("turn_count").alias("stored_turns"), zero("n").alias("actual_turns"), F.greatest(F.lit(0), zero("n") - zero("turn_count")).alias("missing"))


@query("""WITH gone AS (SELECT s.id FROM parsed_sessions s JOIN workspace_info w ON s.workspace_row_id = w.id WHERE w.agent_used LIKE '%codex%') SELECT e.id AS event_id FROM parsed_events e WHERE e.session_row_id IS NULL OR NOT EXISTS (SELECT 1 FROM gone WHERE gone.id = e.session_row_id)""")
def k08_cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    """The events left when an agent's workspaces go with their sessions."""
    gone = table(spark, folder, "parsed_sessions").join(table(spark, folder, "workspace_info").where("agent_used like '%codex%'").select(F.col("id").alias("w")), F.col("workspace_row_id") == F.col("w"), "left_semi")
    return store.without(table(spark, folder, "parsed_events").select(F.col("id").alias("event_id"), "session_row_id"), gone, "session_row_id", "id").select("event_id")


@query("""SELECT id FROM turn_tool_calls c WHERE NOT EXISTS (SELECT 1 FROM turns t WHERE t.session_id = c.session_id AND t.turn = c.turn)""")
def j23_orphan_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls whose turn isn't there, an anti join."""
    calls, turns = table(spark, folder, "turn_tool_calls").select("id", "session_id", "turn"), table(spark, folder, "turns").select("session_id", "turn")
    return calls.join(turns, ["session_id", "turn"], "left_anti").select("id")


@query("""SELECT s.id AS session_row, count(e.id) AS early_events, min(e.event_index) AS first_index FROM parsed_sessions s LEFT JOIN parsed_events e ON e.session_row_id = s.id AND e.event_index < 8 GROUP BY s.id""")
def j11_early_events(spark: SparkSession, folder: str) -> DataFrame:
    """Each session with its first eight events; the bound is part of the join."""
    early = table(spark, folder, "parsed_events").where("event_index < 8").groupBy("session_row_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_index").alias("first_index"))
    return table(spark, folder, "parsed_sessions").select(F.col("id").alias("session_row")).join(early, F.col("session_row") == F.col("session_row_id"), "left").select("session_row", F.coalesce("n", F.lit(0)).alias("early_events"), "first_index")


@query("""SELECT session_id, CASE WHEN json_valid(metadata_json) THEN json_extract_string(metadata_json, '$.source') END AS source, CASE WHEN json_valid(metadata_json) THEN json_extract_string(metadata_json, '$.cli') END AS version, coalesce(nullif(title, ''), session_id) AS title, CASE WHEN parent_session_id != session_id THEN parent_session_id END AS parent FROM parsed_sessions""")
def g06_session_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Source, version, title and parent of each session; a session isn't its own parent."""
    of = lambda k: F.get_json_object("metadata_json", f"$.{k}")
    return table(spark, folder, "parsed_sessions").select("session_id", of("source").alias("source"), of("cli").alias("version"), F.coalesce(F.nullif("title", F.lit("")), "session_id").alias("title"), F.when(F.col("parent_session_id") != F.col("session_id"), F.col("parent_session_id")).alias("parent"))


@query("""WITH f AS (SELECT DISTINCT lower(replace(workspace_folder, chr(92), '/')) AS folder FROM workspace_info WHERE workspace_folder IS NOT NULL AND workspace_folder != '') SELECT a.folder AS folder, b.folder AS inside FROM f a JOIN f b ON starts_with(b.folder, a.folder || '/')""")
def j24_nested_workspaces(spark: SparkSession, folder: str) -> DataFrame:
    """Folders inside other folders: each folder's prefixes are looked up, no theta join."""
    folders = table(spark, folder, "workspace_info").where(A.given("workspace_folder")).select(F.lower(F.replace("workspace_folder", F.lit("\\"), F.lit("/"))).alias("inside")).distinct()
    parts = F.split("inside", "/")
    above = folders.select("inside", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("folder")).where("folder != inside")
    return above.join(folders.select(F.col("inside").alias("folder")), "folder", "left_semi").select("folder", "inside")


def _subset_sql(items: str) -> str:
    return f"""WITH i AS ({items}), s AS (SELECT session_id, list_sort(list_distinct(list(item))) AS items FROM i WHERE session_id IS NOT NULL AND item IS NOT NULL GROUP BY 1), c AS (SELECT *, min(session_id) OVER (PARTITION BY items) AS rep FROM s)
SELECT session_id, rep AS superset FROM c WHERE session_id != rep UNION ALL SELECT a.session_id, b.session_id FROM c a JOIN c b ON a.session_id = a.rep AND b.session_id = b.rep AND len(a.items) < len(b.items) AND list_has_all(b.items, a.items)"""


@query(_subset_sql("SELECT session_id, md5(original_text) AS item FROM turns"))
def j25_subset_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions whose texts all occur in another session."""
    return S.subsets(table(spark, folder, "turns").where("original_text is not null").select("session_id", F.md5("original_text").alias("item")), "session_id", "item")


@query(_subset_sql("SELECT session_id, model_id || ':' || primary_language AS item FROM turns"))
def j25_subset_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions whose pairs of model and language all occur in another session; many are equal."""
    return S.subsets(table(spark, folder, "turns").select("session_id", F.concat(F.col("model_id"), F.lit(":"), F.col("primary_language")).alias("item")), "session_id", "item")


@query("""WITH f AS (SELECT unnest(CAST(json_extract(files, '$[*]') AS JSON[])) AS v FROM turns WHERE files LIKE '[%' AND json_valid(files)), d AS (SELECT DISTINCT regexp_replace(json_extract_string(v, '$'), '/[^/]*$', '') AS folder FROM f WHERE contains(json_extract_string(v, '$'), '/'))
SELECT a.folder, b.folder AS inside FROM d a JOIN (SELECT DISTINCT json_extract_string(v, '$') AS folder FROM f) b ON starts_with(b.folder, a.folder || '/')""")
def j24_files_in_folders(spark: SparkSession, folder: str) -> DataFrame:
    """The folders of files, with all files below them: each file's prefixes are looked up, no theta join."""
    files = table(spark, folder, "turns").select(F.explode(A.text_list(F.col("files"))).alias("inside")).distinct()
    folders = files.where(F.col("inside").contains("/")).select(F.regexp_replace("inside", "/[^/]*$", "").alias("folder")).distinct()
    parts = F.split("inside", "/")
    above = files.where(F.size(parts) > 1).select("inside", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("folder"))
    return above.join(folders, "folder", "left_semi").select("folder", "inside")


@query("SELECT id FROM parsed_events e WHERE NOT EXISTS (SELECT 1 FROM parsed_content_blocks b WHERE b.event_row_id = e.id)")
def j23_events_without_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Events without any block, an anti join."""
    blocks = table(spark, folder, "parsed_content_blocks").select(F.col("event_row_id").alias("id"))
    return table(spark, folder, "parsed_events").select("id").join(blocks, "id", "left_anti")


TERMS = ["heatmap", "sessions"]
_WORDS = r"list_filter(string_split_regex(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda w: w != '')"
_TF = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(TERMS))
_SCORE = " + ".join(f"greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(TERMS)))
_BM25 = f"""d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, len(w) AS dl, {_TF} FROM d),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {', '.join(f'count(*) FILTER (tf{i} > 0) AS df{i}' for i in range(len(TERMS)))} FROM c), k AS (SELECT doc_id, {_SCORE} AS score FROM c, st WHERE {' AND '.join(f'tf{i} > 0' for i in range(len(TERMS)))})"""


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM k")
def r02_keyword_search(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with all terms and their BM25 scores."""
    return S.bm25(table(spark, folder, "documents"), " ".join(TERMS)).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH d AS (SELECT doc_id, {_WORDS} AS w, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS j FROM documents WHERE text IS NOT NULL)
SELECT doc_id FROM d WHERE (contains(j, ' returns the ') OR list_contains(w, 'heatmap') OR len(list_filter(w, lambda x: starts_with(x, 'histo'))) > 0) AND list_contains(w, 'rows') AND NOT list_contains(w, 'session')""")
def r04_boolean_search(spark: SparkSession, folder: str) -> DataFrame:
    """A phrase, a prefix, OR, AND and NOT."""
    return S.bm25(table(spark, folder, "documents"), '("returns the" OR heatmap OR histo*) rows NOT session').select("doc_id")


@query("""WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS s FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id != v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM p) SELECT query_id, vec_id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def r06_semantic_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest rows of each twentieth vector, exact."""
    vectors = table(spark, folder, "embeddings")
    return S.nearest(vectors, vectors.where("vec_id % 20 = 0"), 10).withColumn("score", F.round("score", 6))


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM k ORDER BY k.score DESC, doc_id LIMIT 20 OFFSET 20")
def r01_search_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of a keyword search, by the entry point of all searches."""
    from turnloom.plans.views import search

    return search(table(spark, folder, "documents"), text=" ".join(TERMS), number=2).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id FROM d WHERE list_contains(w, 'uber') OR list_contains(w, 'seccion') OR list_contains(w, '部') OR len(list_filter(w, lambda x: starts_with(x, 'pour'))) > 0""")
def r04_words_of_any_script(spark: SparkSession, folder: str) -> DataFrame:
    """Words are found without regard to case and accents, in any script."""
    return S.bm25(table(spark, folder, "documents"), "Über OR SECCIÓN OR 部 OR pour*").select("doc_id")


@query(f"""WITH {_BM25}, kr AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM k),
s AS (SELECT v.vec_id AS doc_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN embeddings v ON q.vec_id = 20 AND v.vec_id != 20),
sr AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score >= 0.3),
f AS (SELECT coalesce(kr.doc_id, sr.doc_id) AS doc_id, coalesce(1.0 / (60 + kr.rank), 0) + coalesce(1.0 / (60 + sr.rank), 0) AS raw FROM kr FULL JOIN sr ON kr.doc_id = sr.doc_id) SELECT doc_id, round(CAST(raw / (SELECT max(raw) FROM f) AS DOUBLE), 6) AS score FROM f""")
def r07_hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    """All keyword matches and all vectors over the least score, fused by their ranks."""
    from turnloom.plans.views import found

    return found(table(spark, folder, "documents"), table(spark, folder, "embeddings"), " ".join(TERMS), 20, "hybrid").select("doc_id", F.round("score", 6).alias("score"))


@query(f"""SELECT {_DAY} AS day, count(*) AS hits, count(DISTINCT session_id) AS sessions, count(DISTINCT workspace_id) AS workspaces FROM turns WHERE regexp_matches(lower(original_text), '\\bheatmap\\b') AND {_DAY} IS NOT NULL GROUP BY 1""")
def a65_search_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of a word by day."""
    hits = A.per_day(table(spark, folder, "turns").where(F.lower("original_text").rlike(r"\bheatmap\b")))
    return hits.groupBy("day").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("workspace_id").alias("workspaces"))


_MODELS = "SELECT model_id, count(*) AS n FROM turns WHERE model_id IS NOT NULL GROUP BY 1"


@query(f"""WITH c AS ({_MODELS}), b AS (SELECT model_id FROM c ORDER BY n DESC, model_id LIMIT 5) SELECT CASE WHEN model_id IN (SELECT model_id FROM b) THEN model_id ELSE 'others' END AS model_id, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""")
def c01_top_and_others(spark: SparkSession, folder: str) -> DataFrame:
    """The five largest models and the rest."""
    return C.top_and_others(table(spark, folder, "turns").select("model_id", F.lit(1).alias("n")), "model_id", "n", 5)


@query("""WITH s AS (SELECT epoch(max(ts)) - epoch(min(ts)) AS sec FROM events) SELECT CAST(CASE WHEN sec <= 86400 THEN date_trunc('hour', ts) WHEN sec <= 86400 * 14 THEN date_trunc('day', ts) WHEN sec <= 86400 * 84 THEN date_trunc('week', ts) WHEN sec <= 86400 * 730 THEN date_trunc('month', ts) ELSE date_trunc('year', ts) END AS TIMESTAMP) AS bucket, event_type, count(*) AS rows FROM events, s GROUP BY 1, 2""")
def c02_rebucketed(spark: SparkSession, folder: str) -> DataFrame:
    """Events by a bucket of time that suits their span."""
    return C.rebucketed(table(spark, folder, "events"), "ts", "event_type")


@query(f"WITH c AS ({_MODELS}) SELECT model_id, n, round(n * 100.0 / (SELECT sum(n) FROM c), 1) AS pct FROM c")
def c04_percent(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of the whole."""
    return C.percent(table(spark, folder, "turns").where("model_id is not null").groupBy("model_id").agg(F.count(F.lit(1)).alias("n")), "model_id", "n")


@query(f"""WITH c AS (SELECT {_DAY} AS day, count(*) AS n FROM turns WHERE {_DAY} IS NOT NULL GROUP BY 1), g AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM c), (SELECT max(day) FROM c), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT g.day, coalesce(n, 0) AS n, round(ln(coalesce(n, 0) + 1.0) / ln((SELECT max(n) FROM c) + 1.0), 6) AS intensity FROM g LEFT JOIN c ON g.day = c.day""")
def c09_filled_days(spark: SparkSession, folder: str) -> DataFrame:
    """Every day of the span, gaps filled."""
    return C.filled_days(A.per_day(table(spark, folder, "turns")).groupBy("day").agg(F.count(F.lit(1)).alias("n")), "day", "n")


@query("""WITH c AS (SELECT isodow(ts) AS weekday, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2) SELECT CAST(w.weekday AS INTEGER) AS weekday, CAST(h.hour AS INTEGER) AS hour, coalesce(n, 0) AS n FROM (SELECT DISTINCT weekday FROM c) w CROSS JOIN (SELECT unnest(range(24)) AS hour) h LEFT JOIN c ON c.weekday = w.weekday AND c.hour = h.hour""")
def c08_dense_heatmap(spark: SparkSession, folder: str) -> DataFrame:
    """Events by weekday and hour as a full grid."""
    cells = table(spark, folder, "events").groupBy((F.weekday("ts") + 1).alias("weekday"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return C.dense(cells, "weekday", "hour", 24, "n")


@query("""WITH c AS (SELECT primary_language AS word, count(*) AS n FROM turns WHERE primary_language IS NOT NULL GROUP BY 1), s AS (SELECT min(n) AS low, max(n) AS high FROM c) SELECT word, n, round(pow(CASE WHEN high = low THEN 1.0 ELSE (n - low) / CAST(high - low AS DOUBLE) END, 0.8), 6) AS weight FROM c, s""")
def c10_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of a word cloud."""
    return C.weights(table(spark, folder, "turns").where("primary_language is not null").groupBy(F.col("primary_language").alias("word")).agg(F.count(F.lit(1)).alias("n")), "n")


@query("""SELECT session_id, turn, max(id) AS id, arg_max(role, id) AS role, arg_max(original_text, id) AS original_text FROM (SELECT session_id, turn, id, coalesce(role, '') AS role, coalesce(original_text, '') AS original_text FROM turns WHERE session_id IS NOT NULL AND turn IS NOT NULL) GROUP BY 1, 2""")
def k01_latest_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The table after upserts on (session, turn): the last row taken in stays."""
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return store.latest(table(spark, folder, "turns").where("session_id is not null and turn is not null").select("session_id", "turn", "id", blank("role"), blank("original_text")), ["session_id", "turn"], "id")


@query("""SELECT workspace_row_id AS session_id, arg_max(title, CASE WHEN title IS NOT NULL AND title != '' THEN id END) AS title, arg_max(source_path, CASE WHEN source_path IS NOT NULL AND source_path != '' THEN id END) AS source_path, min(started_at_ms) AS started_at_ms, max(ended_at_ms) AS ended_at_ms, count(*) AS fragments FROM parsed_sessions WHERE workspace_row_id IS NOT NULL GROUP BY 1""")
def k06_merged_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """The sessions of a workspace as fragments of one, merged."""
    rows = table(spark, folder, "parsed_sessions").select(F.col("workspace_row_id").alias("session_id"), "id", "title", "source_path", "started_at_ms", "ended_at_ms")
    return store.merged_fragments(rows, "session_id", "id")


@query("""WITH i AS (SELECT workspace_row_id, parent_session_id AS session_id, 'taken in again' AS title FROM parsed_sessions WHERE parent_session_id IS NOT NULL)
SELECT workspace_row_id, session_id, title FROM parsed_sessions WHERE workspace_row_id IS NULL OR workspace_row_id NOT IN (SELECT workspace_row_id FROM i WHERE workspace_row_id IS NOT NULL) UNION ALL SELECT * FROM i""")
def k05_replaced_workspaces(spark: SparkSession, folder: str) -> DataFrame:
    """The workspaces that have children taken in again, as the parents only; what was there of them is replaced."""
    rows = table(spark, folder, "parsed_sessions")
    incoming = rows.where("parent_session_id is not null").select("workspace_row_id", F.col("parent_session_id").alias("session_id"), F.lit("taken in again").alias("title"))
    return store.replaced(rows.select("workspace_row_id", "session_id", "title"), incoming, "workspace_row_id")


@query("""SELECT session_id, turns, last_ms FROM (SELECT session_id, count(*) AS turns, max(CASE WHEN timestamp_ms > 0 THEN timestamp_ms END) AS last_ms FROM turns WHERE session_id IS NOT NULL GROUP BY 1) ORDER BY last_ms DESC NULLS LAST, session_id LIMIT 20 OFFSET 20""")
def o06_session_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of the sessions, latest first, those without a time last."""
    sessions = table(spark, folder, "turns").where("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"), F.max(F.when(F.col("timestamp_ms") > 0, F.col("timestamp_ms"))).alias("last_ms"))
    return C.page(sessions, 2, 20, F.col("last_ms").desc_nulls_last(), F.col("session_id"))
