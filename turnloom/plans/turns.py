"""Queries on turns and exchanges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnloom.operators import turns as T
from turnloom.plans.registry import query
from turnloom.sources.tables import table


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "turns")


_ORDERED = "(SELECT * FROM turns WHERE session_id IS NOT NULL AND turn IS NOT NULL)"


@query(f"""
WITH o AS (SELECT *, lead(role) OVER w AS nrole, lead(turn) OVER w AS nturn, lead(original_text) OVER w AS ntext, lead(model_id) OVER w AS nmodel,
  lead(original_text_tokens) OVER w AS ntok, lead(total_lines_added) OVER w AS nadd, lead(total_lines_removed) OVER w AS nrem,
  count(*) FILTER (role = 'user') OVER (PARTITION BY session_id ORDER BY turn, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS ix
  FROM {_ORDERED} WINDOW w AS (PARTITION BY session_id ORDER BY turn, id))
SELECT session_id || '_' || ix AS id, session_id, CAST(ix AS BIGINT) AS exchange_index, turn AS user_turn, coalesce(original_text, '') AS user_text,
  CASE WHEN nrole = 'assistant' THEN nturn END AS assistant_turn, coalesce(CASE WHEN nrole = 'assistant' THEN ntext END, '') AS assistant_text,
  coalesce(nullif(CASE WHEN nrole = 'assistant' THEN nmodel END, ''), model_id, '') AS model_id, coalesce(nrole = 'assistant', false) AS has_assistant_response,
  CAST(coalesce(original_text_tokens, 0) + coalesce(CASE WHEN nrole = 'assistant' THEN ntok END, 0) AS BIGINT) AS total_tokens,
  CAST(coalesce(CASE WHEN nrole = 'assistant' THEN nadd END, 0) AS BIGINT) AS lines_added, CAST(coalesce(CASE WHEN nrole = 'assistant' THEN nrem END, 0) AS BIGINT) AS lines_removed
FROM o WHERE role = 'user'""")
def v_combined_turns(spark: SparkSession, folder: str) -> DataFrame:
    """User turns with the reply that follows."""
    return T.combined_turns(_turns(spark, folder))


@query(f"""
WITH o AS (SELECT *, last_value(CASE WHEN role = 'user' THEN struct_pack(t := turn, ms := timestamp_ms) END IGNORE NULLS)
  OVER (PARTITION BY session_id ORDER BY turn, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM {_ORDERED}),
r AS (SELECT id, session_id, turn, u.t AS responding_to, CASE WHEN u.t IS NOT NULL THEN coalesce(response_time_ms, CASE WHEN timestamp_ms > 0 AND u.ms > 0 THEN timestamp_ms - u.ms END) END AS ms FROM o WHERE role = 'assistant')
SELECT id, session_id, turn, responding_to, CASE WHEN ms >= 0 THEN ms END AS response_ms FROM r""")
def t_responses(spark: SparkSession, folder: str) -> DataFrame:
    """The user turn that each assistant turn responds to, and how long it took."""
    return T.responses(_turns(spark, folder))


_TOTAL = "coalesce(original_text_tokens, 0) + coalesce(code_tokens, 0) + coalesce(tool_tokens, 0) + coalesce(system_tokens, 0)"


@query(f"""
SELECT id, session_id, turn, {_TOTAL} AS total_tokens, CAST(coalesce(sum({_TOTAL}) OVER (PARTITION BY session_id ORDER BY turn, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS history_tokens FROM {_ORDERED}""")
def t_history_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of a session before each turn."""
    return T.history_tokens(_turns(spark, folder))


@query(f"""
WITH o AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY session_id ORDER BY turn, id) THEN 0 ELSE 1 END AS changed FROM {_ORDERED} WHERE role IS NOT NULL),
r AS (SELECT *, CAST(sum(changed) OVER (PARTITION BY session_id ORDER BY turn, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS BIGINT) AS run FROM o)
SELECT session_id, run, role, count(*) AS rows, min(turn) AS first_turn, max(turn) AS last_turn, CAST(sum(coalesce(length(original_text), 0)) AS BIGINT) AS text_chars,
  min(CASE WHEN timestamp_ms > 0 THEN timestamp_ms END) AS first_ms, CAST(sum(coalesce(original_text_tokens, 0)) AS BIGINT) AS tokens FROM r GROUP BY session_id, run, role""")
def t_role_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring turns of one role folded into one."""
    return T.role_runs(_turns(spark, folder))
