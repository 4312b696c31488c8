"""Conversations from events: what belongs to one, and the turns that its events make.

EVENT is what the operators read; more columns don't matter. The rules of a reader that walks a session's events one
by one are said here as flags and running values over the order (event_index, id), in buckets of a session, so no
session is one task's work until its turns are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.text import trimmed
from turnloom.operators.neighbours import previous_row, running
from turnloom.session import cut_lineage

EVENT = (
    "session string, event_index bigint, id bigint, role string, text string, is_meta boolean, command string, command_text string, block_kinds array<string>, block_texts array<string>, has_results boolean, "
    "thinking_text string, timestamp_ms bigint, timestamp_iso string, request_id string, model_id string, file_paths array<string>, tool_names array<string>, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_creation_tokens bigint"
)
#: Kinds of blocks that hold the result of a tool.
RESULT_KINDS = ("tool_result", "web_search_tool_result", "web_fetch_tool_result", "code_execution_tool_result", "bash_code_execution_tool_result", "text_editor_code_execution_tool_result", "tool_search_tool_result", "mcp_tool_result")
#: Commands that say nothing to the assistant.
QUIET_COMMANDS = ("clear", "effort")
#: Kinds of blocks that aren't shown.
HIDDEN_KINDS = ("thinking", "codeblockUri")
#: Events of a session in one window task, at most (an index given once).
SPAN = 4096
_ORDER = ["event_index", "id"]


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_caveat(text: Column, meta: Column) -> Column:
    """A notice that what follows was typed for the machine."""
    return _true(meta & F.lower(text).contains("<local-command-caveat>"))


def is_output(text: Column) -> Column:
    """What a local command printed."""
    return _true(F.lower(F.ltrim(text)).rlike(r"^\s*<local-command-std(?:out|err)>"))


def is_quiet(command: Column) -> Column:
    """A command that belongs to no conversation."""
    return _true(F.regexp_replace(F.lower(F.trim(command)), "^/+", "").isin(*QUIET_COMMANDS))


def is_results_only(kinds: Column) -> Column:
    """Blocks that are all results of tools, one at least."""
    return _true((F.size(kinds) > 0) & (F.size(F.array_except(kinds, F.array(*map(F.lit, RESULT_KINDS)))) == 0))


def meaningful(text: Column, thinking: Column, tools: Column, attachments: Column) -> Column:
    """An event that says or does anything."""
    said = lambda c: _true(F.trim(c) != "")
    return said(text) | said(thinking) | _true(F.size(tools) > 0) | _true(F.size(attachments) > 0)


def command_of(text: Column) -> Column:
    """Struct(name, args, text) of a command envelope, text being '/name args'; NULL without one."""
    part = lambda tag: F.trim(F.regexp_extract(text, rf"<{tag}>\s*([^<]+?)\s*</{tag}>", 1))
    name, args = part("command-name"), part("command-args")
    return F.when(name != "", F.struct(name.alias("name"), args.alias("args"), F.trim(F.concat_ws(" ", F.concat(F.lit("/"), F.regexp_replace(name, "^/+", "")), args)).alias("text")))


def display_text(role: Column, text: Column, command_text: Column, kinds: Column, texts: Column) -> Column:
    """What an event shows: a user's command or text; else its blocks without hidden ones, an assistant's one after another; else its text."""
    kept = F.filter(F.arrays_zip(kinds.alias("k"), texts.alias("t")), lambda b: ~b["k"].isin(*HIDDEN_KINDS) & _true(b["t"] != ""))
    parts = F.transform(kept, lambda b: b["t"])
    joined = F.when(F.size(parts) > 0, F.when(role == "assistant", F.array_join(parts, "")).otherwise(F.array_join(parts, "\n\n")))
    return F.when(role == "user", F.coalesce(F.nullif(command_text, F.lit("")), text)).otherwise(F.coalesce(joined, text))


_PLACE = ["session", *_ORDER]


def _kept(events: DataFrame) -> DataFrame:
    """(session, event_index, id, role, follow_up) of the events of conversation_events. Narrow rows only, written after each step, since a step reads them twice."""
    rows = events.where("session is not null and event_index is not null")
    user, other = F.col("role") == "user", ~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))
    results = is_results_only(F.col("block_kinds"))
    caveat, output, quiet = is_caveat(F.col("text"), F.col("is_meta")), is_output(F.col("text")), is_quiet(F.col("command"))
    what = (
        F.when(other, F.when(_true(F.col("has_results")), "follow"))
        .when(~user, "assistant").when(caveat, "caveat").when(output & (results | quiet), None).when(quiet, None).when(output, "output").when(results, "follow").otherwise("user")
    )
    rows = cut_lineage(rows.select(*_PLACE, "role", what.alias("what")).where("what is not null"))
    bucket = F.floor(F.col("event_index") / SPAN)
    if not rows.where("what in ('caveat', 'output')").isEmpty():
        mark = F.struct(*_ORDER, (F.col("what") == "caveat").alias("caveat"))
        rows = running(rows, "session", bucket, _ORDER, maxes={"mark": F.when(F.col("what").isin("caveat", "user"), mark)})
        rows = cut_lineage(rows.where("what != 'caveat' and not (what = 'output' and coalesce(mark.caveat, false))").withColumn("what", F.when(F.col("what") == "output", "user").otherwise(F.col("what"))).drop("mark"))
    rows = running(rows, "session", bucket, _ORDER, maxes={"seen": (F.col("what") == "user").cast("int")})
    rows = cut_lineage(rows.where("what = 'user' or seen = 1").drop("seen"))
    rows = previous_row(rows, "session", bucket, _ORDER, F.struct("what"))
    kept = (F.col("what") != "follow") | (F.col("previous.what") == "assistant")
    return rows.where(_true(kept)).select(*_PLACE, "role", (F.col("what") == "follow").alias("follow_up"))


def conversation_events(events: DataFrame) -> DataFrame:
    """The events of EVENT that belong to a conversation, with follow_up: results that go with the assistant event before.

    Nothing counts before the first real user event. Left out are caveats, the output of local commands after a
    caveat (until the user speaks again), quiet commands, and results that don't follow an assistant event directly.
    Events of other roles count only as results. Events without a session, index or id have no place; an id is given once in a session and index.
    """
    return events.join(_kept(events).drop("role"), _PLACE)


def turns_of(events: DataFrame) -> DataFrame:
    """One row per turn: (session, turn, role, text, thinking_text, timestamp_ms, timestamp_iso, request_id, request_ids, model_id, files, tools, events, token_usage).

    Neighbouring events of one role are one turn, and results go with the assistant's turn before them: they give
    it ids, models, files and tokens, no text, tools or time. Texts are joined with an empty line, the time is the
    earliest, ids keep their order, files and tools are sorted; token_usage is JSON of the counts that aren't 0. A
    turn is one row, so its own events are brought together, no more than that.
    """
    bucket = F.floor(F.col("event_index") / SPAN)
    rows = cut_lineage(_kept(events))
    rows = running(rows, "session", bucket, _ORDER, maxes={"spoke": F.when(~F.col("follow_up"), F.struct(*_ORDER, "role"))})
    rows = cut_lineage(rows.withColumn("changed", F.when(F.col("follow_up"), 0).otherwise(F.coalesce(F.col("role") != F.col("spoke.role"), F.lit(True)).cast("int"))).drop("spoke", "role"))
    rows = running(rows, "session", bucket, _ORDER, sums={"earlier": F.col("changed")})
    rows = events.join(rows, _PLACE)
    own = ~F.col("follow_up")
    text = display_text(F.col("role"), F.col("text"), F.col("command_text"), F.col("block_kinds"), F.col("block_texts"))
    given = lambda c: F.when(c != "", c)
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(*_ORDER, c.alias("v"))))), lambda x: x["v"])
    place = F.struct(*_ORDER)
    many = lambda name, cond: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(cond & F.col(name).isNotNull(), F.filter(name, lambda x: x.isNotNull() & (x != "")))))))
    timed = F.when(own & F.col("timestamp_ms").isNotNull(), F.struct("timestamp_ms", *_ORDER))
    turns = rows.groupBy("session", (F.col("earlier") + F.col("changed") - 1).cast("bigint").alias("turn")).agg(
        F.min_by("role", F.when(own, place)).alias("role"),
        trimmed(F.array_join(listed(F.when(own, given(text))), "\n\n")).alias("text"),
        trimmed(F.array_join(listed(F.when(own, given(F.col("thinking_text")))), "\n\n")).alias("thinking_text"),
        F.min(F.when(own, F.col("timestamp_ms"))).alias("timestamp_ms"), F.min_by("timestamp_iso", timed).alias("timestamp_iso"),
        F.array_distinct(listed(given(F.col("request_id")))).alias("request_ids"), F.coalesce(F.min_by("model_id", F.when(F.col("model_id") != "", place)), F.lit("")).alias("model_id"),
        many("file_paths", F.lit(True)).alias("files"), many("tool_names", own).alias("tools"), F.count(F.lit(1)).alias("events"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")],
    )
    usage = F.struct(*[F.nullif(c, F.lit(0).cast("bigint")).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")])
    json = F.nullif(F.to_json(usage), F.lit("{}"))
    return turns.select("session", "turn", "role", "text", "thinking_text", "timestamp_ms", "timestamp_iso", F.coalesce(F.get("request_ids", F.lit(0)), F.lit("")).alias("request_id"), "request_ids", "model_id", "files", "tools", "events", json.alias("token_usage"))


_ARGUMENTS = "struct<file_path:string,path:string,content:string,old_string:string,new_string:string>"


def code_edits(calls: DataFrame) -> DataFrame:
    """(id, file, before, after, diff) of the edits that tool calls (id, name, arguments, file_paths, raw) describe, by JSON.

    A write gives the file after, an edit what is replaced and by what, a patch (raw.changes: path to unified_diff) one
    row per file with its diff. The file is the first of file_paths, else an argument; calls without one, of other
    names or with unreadable JSON give no rows.
    """
    name = F.lower("name")
    readable = F.try_parse_json("arguments").isNotNull()
    of = F.from_json(F.when(readable, F.col("arguments")), _ARGUMENTS)
    paths = F.from_json(F.when(F.try_parse_json("file_paths").isNotNull(), F.col("file_paths")), "array<string>")
    base = calls.where(name.isin("write", "edit")).select("id", name.alias("name"), of.alias("a"), F.coalesce(F.nullif(F.get(paths, F.lit(0)), F.lit("")), F.nullif(of["file_path"], F.lit("")), F.nullif(of["path"], F.lit(""))).alias("file"))
    write = F.col("name") == "write"
    none = F.lit(None).cast("string")
    plain = base.where("file is not null").select("id", "file", F.when(~write, F.coalesce("a.old_string", F.lit(""))).alias("before"), F.when(write, F.coalesce("a.content", F.lit(""))).otherwise(F.coalesce("a.new_string", F.lit(""))).alias("after"), none.alias("diff"))
    changes = F.from_json(F.get_json_object("raw", "$.changes"), "map<string,struct<unified_diff:string>>")
    patches = calls.where(name == "applypatch").select("id", F.explode(changes).alias("file", "change")).where("file != ''")
    return plain.unionByName(patches.select("id", "file", none.alias("before"), none.alias("after"), F.coalesce("change.unified_diff", F.lit("")).alias("diff")))
