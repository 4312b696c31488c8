"""The queries behind the system and workspace dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.dates import utc_sql
from turnloom.operators import analytics as A
from turnloom.operators.turns import combined_turns
from turnloom.plans.registry import SQL, query
from turnloom.sources.tables import table

#: Words that word lists leave out.
STOP_WORDS = tuple("the and for with that this from you your are was were have has had will can could should would not but what when where which who why how its it's to of in on at as by or if is be we they them their i me my our us so an a it there here than then also just into about over under please thanks ok okay yes yeah sure well now let lets".split())
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)

_CAP = """cap AS (SELECT median_ms, CAST(CASE WHEN median_ms > 0 THEN greatest(60000, least(3600000, median_ms * 10)) ELSE 600000 END AS BIGINT) AS cap_ms FROM
  (SELECT coalesce(CAST(floor(median(response_time_ms)) AS BIGINT), 0) AS median_ms FROM turns WHERE role = 'assistant' AND response_time_ms > 0))"""
_PAIRS = f"""{_CAP}, pairs AS (SELECT a.session_id, coalesce(a.agent_used, u.agent_used, 'unknown') AS agent, coalesce(a.model_id, u.model_id, 'unknown') AS model, u.timestamp_ms AS user_ms,
  CASE WHEN a.timestamp_ms > u.timestamp_ms AND a.timestamp_ms - u.timestamp_ms <= cap_ms THEN a.timestamp_ms - u.timestamp_ms ELSE 60000 END AS agentic_ms
  FROM turns a JOIN turns u ON u.session_id = a.session_id AND u.turn = a.responding_to_turn AND u.role = 'user', cap
  WHERE a.role = 'assistant' AND a.{A.IN_MS} AND u.{A.IN_MS})"""
_DAYS = f"(SELECT *, CAST({utc_sql('timestamp_iso')} AS DATE) AS day FROM turns WHERE {utc_sql('timestamp_iso')} IS NOT NULL)"


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "turns")


@query("""SELECT (SELECT count(*) FROM workspace_info) AS workspaces, count(DISTINCT session_id) AS sessions, count(id) // 2 AS exchanges, CAST(coalesce(sum(total_lines_added), 0) AS BIGINT) AS lines_added FROM turns""")
def a01_system_stats(spark: SparkSession, folder: str) -> DataFrame:
    """One row of totals; exchanges are half of the turns, rounded down."""
    turns = _turns(spark, folder).agg(F.countDistinct("session_id").alias("sessions"), F.expr("count(id) div 2").alias("exchanges"), A.whole_sum("total_lines_added").alias("lines_added"))
    return table(spark, folder, "workspace_info").agg(F.count(F.lit(1)).alias("workspaces")).join(turns)


def _share_sql(key: str, where: str = "true") -> str:
    return f"""WITH c AS (SELECT {key}, count(*) AS rows FROM turns WHERE {key} IS NOT NULL AND {key} != '' AND {where} GROUP BY {key})
SELECT {key}, rows, round(rows * 100.0 / (SELECT sum(rows) FROM c), 1) AS share_pct FROM c ORDER BY rows DESC, {key} LIMIT 1"""


@query(_share_sql("agent_used"))
def a02_top_agent(spark: SparkSession, folder: str) -> DataFrame:
    """The most used agent and its share."""
    return A.share_of_first(_turns(spark, folder), "agent_used")


@query(_share_sql("model_id", "role = 'assistant'"))
def a03_top_model(spark: SparkSession, folder: str) -> DataFrame:
    """The model with the most assistant turns and its share."""
    return A.share_of_first(_turns(spark, folder).where("role = 'assistant'"), "model_id")


@query(f"WITH {_CAP} SELECT median_ms, cap_ms FROM cap")
def a24_response_cap(spark: SparkSession, folder: str) -> DataFrame:
    """The median response and the cap made from it."""
    return A.response_cap(_turns(spark, folder))


@query(f"WITH {_PAIRS} SELECT count(*) AS turns, CAST(coalesce(sum(agentic_ms), 0) AS BIGINT) AS total_ms FROM pairs")
def a04_agentic_time(spark: SparkSession, folder: str) -> DataFrame:
    """Capped time between users' turns and the replies."""
    return A.agentic_pairs(_turns(spark, folder)).agg(F.count(F.lit(1)).alias("turns"), A.whole_sum("agentic_ms").alias("total_ms"))


@query(f"WITH {_PAIRS} SELECT model, count(*) AS turns, CAST(sum(agentic_ms) AS BIGINT) AS total_ms, round(sum(agentic_ms) / 3600000.0, 2) AS hours FROM pairs WHERE model != '' GROUP BY model ORDER BY total_ms DESC, model LIMIT 20")
def a05_agentic_time_by_model(spark: SparkSession, folder: str) -> DataFrame:
    """The same by model, the first 20."""
    return A.top(A.agentic_time(_turns(spark, folder), "model"), "total_ms", 20, "model")


@query(f"WITH {_PAIRS} SELECT agent, count(*) AS turns, CAST(sum(agentic_ms) AS BIGINT) AS total_ms, round(sum(agentic_ms) / 3600000.0, 2) AS hours FROM pairs WHERE agent != '' GROUP BY agent")
def a06_agentic_time_by_agent(spark: SparkSession, folder: str) -> DataFrame:
    """The same by agent."""
    return A.agentic_time(_turns(spark, folder), "agent")


@query(f"SELECT day, CAST(coalesce(sum(total_lines_added), 0) AS BIGINT) AS added, CAST(coalesce(sum(total_lines_removed), 0) AS BIGINT) AS removed, CAST(coalesce(sum(total_lines_added), 0) - coalesce(sum(total_lines_removed), 0) AS BIGINT) AS net FROM {_DAYS} GROUP BY day")
def a07_code_velocity(spark: SparkSession, folder: str) -> DataFrame:
    """Lines added and removed per day."""
    sums = A.per_day(_turns(spark, folder)).groupBy("day").agg(A.whole_sum("total_lines_added").alias("added"), A.whole_sum("total_lines_removed").alias("removed"))
    return sums.withColumn("net", F.col("added") - F.col("removed"))


_EXCHANGES = "(" + SQL.get("v_combined_turns", "SELECT 1") + ")"


@query(f"""SELECT model_id, count(*) AS code_turns, CAST(sum(lines_added + lines_removed) AS BIGINT) AS lines, round(sum(lines_added + lines_removed) / CAST(count(*) AS DOUBLE), 4) AS lines_per_turn FROM {_EXCHANGES}
WHERE has_assistant_response AND model_id != '' AND (lines_added > 0 OR lines_removed > 0) GROUP BY model_id HAVING count(*) > 0 ORDER BY sum(lines_added + lines_removed) / CAST(count(*) AS DOUBLE) DESC, model_id LIMIT 20""")
def a08_model_productivity(spark: SparkSession, folder: str) -> DataFrame:
    """Changed lines per exchange with code, by model."""
    code = combined_turns(_turns(spark, folder)).where("has_assistant_response and model_id != '' and (lines_added > 0 or lines_removed > 0)")
    per = code.groupBy("model_id").agg(F.count(F.lit(1)).alias("code_turns"), A.whole_sum(F.col("lines_added") + F.col("lines_removed")).alias("lines"))
    return A.top(per.withColumn("ratio", F.col("lines") / F.col("code_turns")), "ratio", 20, "model_id").select("model_id", "code_turns", "lines", F.round("ratio", 4).alias("lines_per_turn"))


@query("""SELECT model_id, CAST(sum(abs(coalesce(total_lines_added, 0)) + abs(coalesce(total_lines_removed, 0))) AS BIGINT) AS lines, round(sum(abs(coalesce(weighted_complexity_change, 0))), 2) AS complexity
FROM turns WHERE role = 'assistant' AND model_id IS NOT NULL AND model_id != '' GROUP BY model_id ORDER BY lines DESC, model_id LIMIT 25""")
def a09_complexity_impact(spark: SparkSession, folder: str) -> DataFrame:
    """Changed lines and absolute complexity change by model."""
    zero = lambda c: F.abs(F.coalesce(c, F.lit(0)))
    per = _turns(spark, folder).where((F.col("role") == "assistant") & A.given("model_id")).groupBy("model_id").agg(A.whole_sum(zero("total_lines_added") + zero("total_lines_removed")).alias("lines"), F.round(F.sum(zero("weighted_complexity_change")), 2).alias("complexity"))
    return A.top(per, "lines", 25, "model_id")


def _heatmap_sql(back: str) -> str:
    day = "CAST(make_timestamp(user_ms * 1000) AS DATE)"
    return f"""WITH {_PAIRS}, span AS (SELECT min(timestamp_ms) AS first, max(timestamp_ms) AS last FROM turns WHERE role = 'user' AND {A.IN_MS})
SELECT CASE WHEN last - first <= 90 * 86400000::BIGINT THEN {day} ELSE {back.format(day=day)} END AS bucket, CAST(user_ms % 86400000 // 3600000 AS INTEGER) AS hour, CAST(sum(agentic_ms) AS BIGINT) AS total_ms
FROM pairs, span WHERE user_ms >= CASE WHEN last - first <= 365 * 86400000::BIGINT THEN first ELSE last - 365 * 86400000::BIGINT END GROUP BY 1, 2"""


@query(_heatmap_sql("CASE WHEN isodow({day}) = 1 THEN {day} - 7 ELSE {day} - CAST(isodow({day}) - 1 AS INTEGER) END"))
def a10_heatmap(spark: SparkSession, folder: str) -> DataFrame:
    """Agentic time by day or week and hour, Mondays with the week before."""
    return A.heatmap(_turns(spark, folder))


@query(_heatmap_sql("{day} - CAST(isodow({day}) - 1 AS INTEGER)"))
def a10_heatmap_iso(spark: SparkSession, folder: str) -> DataFrame:
    """A10 with ISO weeks."""
    return A.heatmap(_turns(spark, folder), monday_goes_back=False)


@query("SELECT workspace_id, workspace_name, session_count FROM workspace_info")
def a11_session_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions per workspace, as stored."""
    return table(spark, folder, "workspace_info").select("workspace_id", "workspace_name", "session_count")


@query("SELECT coalesce(agent_used, 'unknown') AS agent, count(*) AS turns FROM turns GROUP BY 1")
def a12_agent_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Turns per agent."""
    return _turns(spark, folder).groupBy(F.coalesce("agent_used", F.lit("unknown")).alias("agent")).agg(F.count(F.lit(1)).alias("turns"))


@query("SELECT model_id, count(*) AS turns FROM turns WHERE role = 'assistant' AND model_id IS NOT NULL AND model_id != '' GROUP BY model_id ORDER BY turns DESC, model_id LIMIT 15")
def a13_model_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns of the 15 most used models."""
    return A.top(_turns(spark, folder).where((F.col("role") == "assistant") & A.given("model_id")).groupBy("model_id").agg(F.count(F.lit(1)).alias("turns")), "turns", 15, "model_id")


@query("""SELECT w.workspace_name, CAST(coalesce(sum(t.total_lines_added), 0) AS BIGINT) AS added FROM turns t JOIN workspace_info w USING (workspace_id) WHERE w.workspace_name IS NOT NULL GROUP BY w.workspace_name ORDER BY added DESC, w.workspace_name LIMIT 10""")
def a14_code_per_workspace(spark: SparkSession, folder: str) -> DataFrame:
    """Lines added in the ten busiest workspaces. Turns are summed per workspace before they meet the names."""
    sums = _turns(spark, folder).groupBy("workspace_id").agg(F.sum("total_lines_added").alias("n"))
    names = table(spark, folder, "workspace_info").where("workspace_name is not null").select("workspace_id", "workspace_name")
    return A.top(sums.join(names, "workspace_id").groupBy("workspace_name").agg(A.whole_sum("n").alias("added")), "added", 10, "workspace_name")


@query(f"""SELECT day, count(DISTINCT session_id) AS sessions, count(*) // 2 AS exchanges, count(DISTINCT CASE WHEN files IS NOT NULL AND files != '' AND files != '[]' THEN request_id END) AS requests_with_files FROM {_DAYS} GROUP BY day""")
def a15_session_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions, exchanges and requests that touched files, per day."""
    files = A.given("files") & (F.col("files") != "[]")
    return A.per_day(_turns(spark, folder)).groupBy("day").agg(F.countDistinct("session_id").alias("sessions"), F.expr("count(*) div 2").alias("exchanges"), F.countDistinct(F.when(files, F.col("request_id"))).alias("requests_with_files"))


@query("SELECT workspace_id, workspace_name, agent_used, updated_at FROM workspace_info WHERE updated_at IS NOT NULL ORDER BY updated_at DESC, workspace_id LIMIT 10")
def a16_recent_workspaces(spark: SparkSession, folder: str) -> DataFrame:
    """The ten workspaces updated last."""
    return A.top(table(spark, folder, "workspace_info").where("updated_at is not null").select("workspace_id", "workspace_name", "agent_used", "updated_at"), "updated_at", 10, "workspace_id")


@query("""SELECT l_partkey AS file_key, count(DISTINCT l_orderkey) AS requests, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS added, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS removed FROM lineitem GROUP BY l_partkey ORDER BY requests DESC, added DESC, file_key LIMIT 50""")
def a18_file_bottlenecks(spark: SparkSession, folder: str) -> DataFrame:
    """The files (parts) that most requests (orders) change; two keys descending."""
    per = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("file_key")).agg(F.countDistinct("l_orderkey").alias("requests"), A.whole_sum(F.col("l_quantity").cast("bigint")).alias("added"), A.whole_sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("removed"))
    return per.orderBy(F.col("requests").desc(), F.col("added").desc(), "file_key").limit(50)


@query("""SELECT CAST(o_orderdate AS DATE) AS day, l_partkey AS file_key, round(avg(CAST(round(l_tax * 100) AS DOUBLE)), 3) AS complexity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def a17_file_evolution(spark: SparkSession, folder: str) -> DataFrame:
    """The average change per day and file."""
    items = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_partkey").alias("file_key"), F.round(F.col("l_tax") * 100).alias("c"))
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("day"))
    return items.join(orders, "l_orderkey").groupBy("day", "file_key").agg(F.round(F.avg("c"), 3).alias("complexity"))


@query("SELECT primary_language AS language, count(*) AS turns FROM turns WHERE role = 'assistant' AND primary_language IS NOT NULL AND primary_language != '' GROUP BY 1 ORDER BY turns DESC, language LIMIT 20")
def a19_language_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns of the 20 most used languages."""
    rows = _turns(spark, folder).where((F.col("role") == "assistant") & A.given("primary_language"))
    return A.top(rows.groupBy(F.col("primary_language").alias("language")).agg(F.count(F.lit(1)).alias("turns")), "turns", 20, "language")


@query(f"""WITH d AS (SELECT day, primary_language FROM {_DAYS} WHERE primary_language IS NOT NULL AND primary_language != ''), b AS (SELECT primary_language FROM d GROUP BY 1 ORDER BY count(*) DESC, primary_language LIMIT 10),
c AS (SELECT day, primary_language, count(*) AS rows FROM d JOIN b USING (primary_language) GROUP BY 1, 2)
SELECT g.day, b.primary_language, coalesce(c.rows, 0) AS rows FROM (SELECT DISTINCT day FROM c) g CROSS JOIN b LEFT JOIN c ON c.day = g.day AND c.primary_language = b.primary_language""")
def a20_language_evolution(spark: SparkSession, folder: str) -> DataFrame:
    """Turns per day of the ten most used languages, zeros filled in."""
    return A.pivot_top(A.per_day(_turns(spark, folder)), "primary_language", "day", 10)


@query("""SELECT primary_language AS language, round(avg(abs(weighted_complexity_change)), 4) AS mean_change, count(DISTINCT request_id) AS requests FROM turns WHERE primary_language IS NOT NULL AND primary_language != '' AND weighted_complexity_change IS NOT NULL GROUP BY 1""")
def a21_language_complexity(spark: SparkSession, folder: str) -> DataFrame:
    """The mean absolute complexity change per language."""
    rows = _turns(spark, folder).where(A.given("primary_language") & F.col("weighted_complexity_change").isNotNull())
    return rows.groupBy(F.col("primary_language").alias("language")).agg(F.round(F.avg(F.abs("weighted_complexity_change")), 4).alias("mean_change"), F.countDistinct("request_id").alias("requests"))


@query(f"""SELECT model_id, CAST(sum(lines_added) AS BIGINT) AS added, CAST(sum(lines_removed) AS BIGINT) AS removed,
round(CASE WHEN sum(lines_removed) > 0 THEN sum(lines_added) / CAST(sum(lines_removed) AS DOUBLE) WHEN sum(lines_added) > 0 THEN 999.99 ELSE 1.0 END, 4) AS ratio FROM {_EXCHANGES} WHERE has_assistant_response AND model_id != '' GROUP BY model_id""")
def a22_add_delete_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Lines added per line removed, by model; 999.99 without removals, 1 without any change."""
    sums = combined_turns(_turns(spark, folder)).where("has_assistant_response and model_id != ''").groupBy("model_id").agg(A.whole_sum("lines_added").alias("added"), A.whole_sum("lines_removed").alias("removed"))
    return sums.withColumn("ratio", F.round(F.when(F.col("removed") > 0, F.try_divide("added", "removed")).when(F.col("added") > 0, 999.99).otherwise(1.0), 4))


_TOKENS = "SELECT unnest(regexp_extract_all(lower(coalesce({c}, '')), '[a-z][a-z0-9_]+')) AS word{more} FROM {t}"


@query(f"SELECT word, count(*) AS rows FROM ({_TOKENS.format(c='text', more='', t='turns')}) WHERE length(word) >= 3 AND word NOT IN ({_STOP}) GROUP BY word ORDER BY rows DESC, word LIMIT 500")
def a23_word_cloud(spark: SparkSession, folder: str) -> DataFrame:
    """The 500 most frequent words of the turns' whole texts."""
    return A.top(A.word_counts(_turns(spark, folder), "text", STOP_WORDS), "rows", 500, "word")


@query(f"""WITH c AS (SELECT agent, word, count(*) AS rows FROM ({_TOKENS.format(c='text', more=", coalesce(agent_used, 'unknown') AS agent", t='turns')}) WHERE length(word) >= 3 AND word NOT IN ({_STOP}) GROUP BY 1, 2)
SELECT agent, word, rows, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY rows DESC, word) AS rank FROM c) WHERE rank <= 50""")
def a63_word_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 most frequent words per agent."""
    words = _turns(spark, folder).select(F.coalesce("agent_used", F.lit("unknown")).alias("agent"), F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[a-z][a-z0-9_]+"), F.lit(0))).alias("word"))
    counts = words.where((F.length("word") >= 3) & ~F.col("word").isin(*STOP_WORDS)).groupBy("agent", "word").agg(F.count(F.lit(1)).alias("rows"))
    return A.ranked(counts, "agent", "rows", 50, "word")


@query("""SELECT workspace_folder AS folder, string_agg(DISTINCT agent_used, ',' ORDER BY agent_used) AS agents, count(DISTINCT session_id) AS sessions, count(*) AS turns,
CAST(coalesce(sum(original_text_tokens), 0) + coalesce(sum(code_tokens), 0) + coalesce(sum(tool_tokens), 0) + coalesce(sum(system_tokens), 0) AS BIGINT) AS tokens FROM turns WHERE workspace_folder IS NOT NULL GROUP BY workspace_folder""")
def a30_extraction_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Agents, sessions, turns and tokens per workspace folder."""
    tokens = sum((A.whole_sum(c) for c in ("code_tokens", "tool_tokens", "system_tokens")), A.whole_sum("original_text_tokens"))
    agents = F.array_join(F.array_sort(F.collect_set("agent_used")), ",")
    return _turns(spark, folder).where("workspace_folder is not null").groupBy(F.col("workspace_folder").alias("folder")).agg(F.nullif(agents, F.lit("")).alias("agents"), F.countDistinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("turns"), tokens.alias("tokens"))


@query("SELECT event_type, CAST(sum(coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS total, count(*) AS rows FROM events GROUP BY event_type")
def a31_json_metric(spark: SparkSession, folder: str) -> DataFrame:
    """A number inside JSON, summed with a default of 0."""
    return table(spark, folder, "events").groupBy("event_type").agg(A.whole_sum(F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0))).alias("total"), F.count(F.lit(1)).alias("rows"))


@query("""WITH t AS (SELECT unnest(TRY_CAST(json_extract(tools, '$[*]') AS JSON[])) AS v FROM turns WHERE tools IS NOT NULL AND tools LIKE '[%' AND json_valid(tools)),
n AS (SELECT CASE WHEN json_type(v) = 'OBJECT' THEN json_extract_string(v, '$.name') ELSE json_extract_string(v, '$') END AS tool FROM t) SELECT tool, count(*) AS uses FROM n WHERE tool IS NOT NULL AND tool != '' GROUP BY tool""")
def a36_tool_usage(spark: SparkSession, folder: str) -> DataFrame:
    """How often each tool is used, from JSON arrays in the rows."""
    return _turns(spark, folder).select(F.explode(A.text_list(F.col("tools"))).alias("tool")).groupBy("tool").agg(F.count(F.lit(1)).alias("uses"))


@query(f"SELECT day, count(*) AS sessions FROM (SELECT session_id, min(day) AS day FROM {_DAYS} WHERE session_id IS NOT NULL GROUP BY session_id) GROUP BY day")
def a37_session_starts(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions by the day of their first turn; two levels of grouping."""
    first = A.per_day(_turns(spark, folder)).where("session_id is not null").groupBy("session_id").agg(F.min("day").alias("day"))
    return first.groupBy("day").agg(F.count(F.lit(1)).alias("sessions"))


@query("""SELECT workspace_id, coalesce(agent_used, '') AS agent, count(*) AS turns, count(DISTINCT session_id) AS sessions, min(CASE WHEN timestamp_ms > 0 THEN timestamp_ms END) AS first_ms, max(CASE WHEN timestamp_ms > 0 THEN timestamp_ms END) AS last_ms FROM turns WHERE workspace_id IS NOT NULL GROUP BY 1, 2""")
def a55_workspace_status(spark: SparkSession, folder: str) -> DataFrame:
    """Turns, sessions and time span per workspace and agent."""
    ms = F.when(F.col("timestamp_ms") > 0, F.col("timestamp_ms"))
    return _turns(spark, folder).where("workspace_id is not null").groupBy("workspace_id", F.coalesce("agent_used", F.lit("")).alias("agent")).agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("session_id").alias("sessions"), F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"))


@query("""WITH g AS (SELECT workspace_id, workspace_name, workspace_folder, agent_used, count(DISTINCT session_id) AS sessions, count(*) AS turns FROM turns WHERE workspace_id IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT workspace_id, string_agg(DISTINCT agent_used, ',' ORDER BY agent_used) AS agents, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(turns) AS BIGINT) AS turns, min(workspace_name) AS name FROM g GROUP BY workspace_id""")
def a56_database_workspaces(spark: SparkSession, folder: str) -> DataFrame:
    """A group per name, folder and agent, summed again per workspace; a session counts once per group."""
    groups = _turns(spark, folder).where("workspace_id is not null").groupBy("workspace_id", "workspace_name", "workspace_folder", "agent_used").agg(F.countDistinct("session_id").alias("s"), F.count(F.lit(1)).alias("n"))
    return groups.groupBy("workspace_id").agg(F.nullif(F.array_join(F.array_sort(F.collect_set("agent_used")), ","), F.lit("")).alias("agents"), A.whole_sum("s").alias("sessions"), A.whole_sum("n").alias("turns"), F.min("workspace_name").alias("name"))


@query("""SELECT session_id, count(*) AS turns, min(CASE WHEN timestamp_ms > 0 THEN timestamp_ms END) AS first_ms, max(CASE WHEN timestamp_ms > 0 THEN timestamp_ms END) AS last_ms, CAST(coalesce(sum(total_lines_added), 0) AS BIGINT) AS added, CAST(coalesce(sum(total_lines_removed), 0) AS BIGINT) AS removed,
string_agg(DISTINCT nullif(primary_language, ''), ',' ORDER BY nullif(primary_language, '')) AS languages, arg_min(session_name, id) FILTER (session_name IS NOT NULL) AS name, min(parent_session_id) AS parent, min(relationship_type) AS relationship FROM turns WHERE session_id IS NOT NULL GROUP BY session_id""")
def a57_session_list(spark: SparkSession, folder: str) -> DataFrame:
    """One row per session; the name is the one of its first row that has one."""
    ms = F.when(F.col("timestamp_ms") > 0, F.col("timestamp_ms"))
    return _turns(spark, folder).where("session_id is not null").groupBy("session_id").agg(
        F.count(F.lit(1)).alias("turns"), F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"), A.whole_sum("total_lines_added").alias("added"), A.whole_sum("total_lines_removed").alias("removed"),
        F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(A.given("primary_language"), F.col("primary_language")))), ","), F.lit("")).alias("languages"),
        F.min_by("session_name", F.when(F.col("session_name").isNotNull(), F.col("id"))).alias("name"), F.min("parent_session_id").alias("parent"), F.min("relationship_type").alias("relationship"),
    )


@query("""SELECT request_id, CAST(sum(coalesce(total_lines_added, 0)) AS BIGINT) AS added, CAST(sum(coalesce(total_lines_removed, 0)) AS BIGINT) AS removed, arg_max(weighted_complexity_change, struct_pack(a := abs(weighted_complexity_change), i := -id)) AS complexity FROM turns WHERE request_id IS NOT NULL AND request_id != '' GROUP BY request_id""")
def a61_request_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of one request merged: lines summed, of complexities the signed one that is largest."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    change = F.col("weighted_complexity_change")
    return _turns(spark, folder).where(A.given("request_id")).groupBy("request_id").agg(A.whole_sum(zero("total_lines_added")).alias("added"), A.whole_sum(zero("total_lines_removed")).alias("removed"), F.max_by(change, F.when(change.isNotNull(), F.struct(F.abs(change), -F.col("id")))).alias("complexity"))
