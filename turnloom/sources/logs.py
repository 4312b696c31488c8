"""Session logs of several assistants, as lines and documents, to one event table.

EVENT is the common shape. A line that isn't a JSON object becomes an issue and no event.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions import jsontree as J
from turnloom.functions.text import path as normal_path
from turnloom.operators.neighbours import running

EVENT = ("file", "event_index", "event_type", "role", "timestamp", "message_id", "parent_id", "session_id", "model_id", "text", "thinking_text", "tool_names", "input_tokens", "output_tokens")


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, event_index, line, valid) of the non-blank lines of JSONL files; event_index is the line number from 0.

    Files are read in splits, however long they are; a line's number is its place in its split and the number of lines
    in the splits of its file before.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split_"), F.monotonically_increasing_id().alias("place_"), F.col("value").alias("line"))
    each = running(read, "file", F.col("split_"), ["place_"], sums={"event_index": F.lit(1)})
    each = each.select("file", F.col("event_index").cast("int").alias("event_index"), "line").where(F.trim("line") != "")
    return each.withColumn("valid", F.try_parse_json("line").isNotNull() & F.trim("line").startswith("{"))


def _carried(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with the last value up to each row of its file that isn't NULL, file by file in buckets of lines."""
    rows = rows.withColumn("own_", value)
    rows = running(rows, "file", F.floor(F.col("event_index") / 4096), ["event_index"], maxes={"held_": F.when(F.col("own_").isNotNull(), F.struct("event_index", "own_"))})
    return rows.withColumn(name, F.coalesce("own_", "held_.own_")).drop("own_", "held_")


def issues(rows: DataFrame) -> DataFrame:
    """(file, line_number, issue) of the lines that can't be read."""
    return rows.where("not valid").select("file", (F.col("event_index") + 1).alias("line_number"), F.lit("invalid_jsonl_line").alias("issue"))


def _get(path: str, column: str = "line") -> Column:
    return F.get_json_object(column, f"$.{path}")


_BLOCK = "array<struct<type:string,text:string,thinking:string,name:string>>"


def _blocks(content: Column) -> Column:
    """Content blocks of a message; a string is one text block."""
    return F.when(content.startswith("["), F.from_json(content, _BLOCK)).when(content.isNotNull(), F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), F.lit(None).cast("string").alias("thinking"), F.lit(None).cast("string").alias("name"))))


def _shaped(rows: DataFrame, **columns: Column) -> DataFrame:
    empty = {"tool_names": "array<string>", "input_tokens": "bigint", "output_tokens": "bigint"}
    return rows.select("file", "event_index", *[columns.get(c, F.lit(None)).cast(empty.get(c, "string")).alias(c) for c in EVENT[2:]])


def tree_events(rows: DataFrame) -> DataFrame:
    """Events of logs whose lines are messages with uuid and parentUuid: {type, uuid, message: {role, content, usage}}."""
    rows = rows.where("valid").withColumn("blocks", _blocks(F.coalesce(_get("message.content"), _get("content"))))
    of = lambda kind, field: F.filter(F.transform(F.filter("blocks", lambda b: b["type"].isin(*kind)), lambda b: b[field]), lambda x: x.isNotNull())
    role = F.coalesce(_get("message.role"), _get("role"), F.when(_get("type").isin("user", "assistant", "system"), _get("type")), F.lit("system"))
    return _shaped(
        rows, event_type=_get("type"), role=role, timestamp=_get("timestamp"), message_id=F.coalesce(_get("uuid"), _get("message.id")), parent_id=_get("parentUuid"), session_id=_get("sessionId"), model_id=_get("message.model"),
        text=F.array_join(of(("text",), "text"), "\n"), thinking_text=F.nullif(F.array_join(of(("thinking",), "thinking"), "\n"), F.lit("")), tool_names=of(("tool_use", "server_tool_use", "mcp_tool_use"), "name"),
        input_tokens=_get("message.usage.input_tokens").try_cast("bigint"), output_tokens=_get("message.usage.output_tokens").try_cast("bigint"),
    )


def rollout_events(rows: DataFrame) -> DataFrame:
    """Events of rollout logs: {type, timestamp, payload}; messages and tool calls count, the model is that of the last turn context before."""
    rows = _carried(rows.where("valid"), "model_", F.when(_get("type") == "turn_context", _get("payload.model")))
    rows = _carried(rows, "session_", F.when(_get("type") == "session_meta", _get("payload.id")))
    kind = _get("payload.type")
    role = F.when(kind == "user_message", "user").when(kind.isin("agent_message", "agent_reasoning", "exec_command_begin", "mcp_tool_call_begin", "patch_apply_begin"), "assistant")
    rows = rows.where((_get("type") == "event_msg") & role.isNotNull())
    name = F.when(kind == "exec_command_begin", "Bash").when(kind == "patch_apply_begin", "ApplyPatch").when(kind == "mcp_tool_call_begin", F.concat_ws(".", _get("payload.invocation.server"), _get("payload.invocation.tool")))
    return _shaped(rows, event_type=kind, role=role, timestamp=_get("timestamp"), message_id=_get("payload.call_id"), session_id=F.col("session_"), model_id=F.col("model_"), text=F.when(kind.isin("user_message", "agent_message"), _get("payload.message")), thinking_text=F.when(kind == "agent_reasoning", _get("payload.text")), tool_names=F.when(name.isNotNull(), F.array(name)))


def command_line_events(rows: DataFrame) -> DataFrame:
    """Events of command-line logs: {type: user.message and so on, timestamp, data: {content, model, toolRequests}}; a model change holds from then on."""
    kind = _get("type")
    model = F.coalesce(F.when(kind == "session.model_change", F.coalesce(_get("data.newModel"), _get("data.model"))), F.when(kind == "session.start", _get("data.selectedModel")), F.when(kind == "assistant.message", _get("data.model")))
    first = rows.where("valid").groupBy(F.col("file").alias("file_")).agg(F.min(F.when(_get("data.sessionId").isNotNull(), F.struct("event_index", _get("data.sessionId").alias("id")))).alias("first_"))
    rows = _carried(rows.where("valid"), "model_", model).join(first, F.col("file") == F.col("file_"))
    rows = rows.withColumn("session_", F.when(F.col("first_.event_index") <= F.col("event_index"), F.col("first_.id")))
    rows = rows.where(kind.isin("user.message", "assistant.message"))
    tools = F.transform(F.from_json(_get("data.toolRequests"), "array<struct<name:string>>"), lambda t: t["name"])
    return _shaped(rows, event_type=kind, role=F.split(kind, r"\.")[0], timestamp=_get("timestamp"), message_id=F.coalesce(_get("data.messageId"), _get("id")), session_id=F.col("session_"), model_id=F.when(kind == "assistant.message", F.col("model_")), text=_get("data.content"), tool_names=tools)


def _index(step: object) -> int | None:
    """A step of a path that is a whole number; the digits of a text are a name."""
    if isinstance(step, J.Number):
        return int(step) if step.isdigit() else None
    return step if isinstance(step, int) and not isinstance(step, bool) and step >= 0 else None


def _inside(at: object, step: object, fresh: type) -> tuple[object, object] | None:
    """(container, key) for a step into a list or an object, what is missing being made; None where it leads nowhere."""
    i = _index(step)
    if isinstance(at, list):
        if i is None:
            return None
        at += [fresh() for _ in range(i + 1 - len(at))]
        return at, i
    return (at, str(step)) if isinstance(at, dict) else None


def replayed(entries: list[object]) -> object:
    """The document that a delta log stands for: its first entry, if of kind 0, is the start; later ones of kind 1 set the value at a path, of kind 2 add a list's values to the list there.

    Missing objects of a path are made, lists padded with empty objects (with empty lists where values are added); a step that fits no
    container, values that are no list and entries of other kinds or without a path change nothing. A document
    without requests gets an empty list of them.
    """
    rows = [e for e in entries if isinstance(e, dict)]
    first = copy.deepcopy(rows[0].get("v")) if rows and str(rows[0].get("kind")) == "0" else {}
    state: dict = first if isinstance(first, dict) else {}
    for e in rows[1:]:
        kind, path = str(e.get("kind")), e.get("k")
        if kind not in ("1", "2") or not isinstance(path, list) or not path:
            continue
        at: object = state
        for step in path[:-1]:
            if (found := _inside(at, step, dict)) is None:
                break
            box, key = found
            if isinstance(box, dict):
                box.setdefault(key, {})
            at = box[key]
        else:
            if (found := _inside(at, path[-1], dict if kind == "1" else list)) is None:
                continue
            box, key = found
            value = copy.deepcopy(e.get("v"))
            if kind == "1":
                box[key] = value
                continue
            if isinstance(box, dict):
                box.setdefault(key, [])
            if isinstance(box[key], list) and isinstance(value, list):
                box[key].extend(value)
    state.setdefault("requests", [])
    return state


def delta_documents(rows: DataFrame) -> DataFrame:
    """(file, document): the document of each delta-log file, folded in line order in one task per file."""

    def fold(df: pd.DataFrame) -> pd.DataFrame:
        entries = []
        for text in df.sort_values("event_index")["line"]:
            try:
                entries.append(J.parse(text))
            except ValueError:
                continue
        state = replayed(entries)
        return pd.DataFrame({"file": [df["file"].iloc[0]], "document": [J.clean(dump(state))]})

    return rows.select("file", "event_index", "line").groupBy("file").applyInPandas(fold, "file string, document string")


def dump(value: object) -> str:
    """JSON text of a value of jsontree.parse."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{J.scalar(k)}:{dump(v)}" for k, v in value.items()) + "}"
    return "[" + ",".join(map(dump, value)) + "]" if isinstance(value, list) else J.scalar(value)


def chat_turns(documents: DataFrame, text: str = "document") -> DataFrame:
    """(file, turn, role, request_id, timestamp_ms, model_id, text): two turns per request of chat documents, the user's 2i and the assistant's 2i + 1."""
    request = "array<struct<requestId:string,timestamp:bigint,modelId:string,message:string,response:string>>"
    each = documents.select("file", F.posexplode(F.from_json(F.get_json_object(text, "$.requests"), request)).alias("i", "r"))
    said = F.when(F.col("r.message").startswith("{"), F.get_json_object("r.message", "$.text")).otherwise(F.col("r.message"))
    parts = F.from_json("r.response", "array<struct<kind:string,value:string>>")
    value = lambda p: F.when(p["value"].startswith("{"), F.get_json_object(p["value"], "$.value")).otherwise(p["value"])
    reply = F.array_join(F.filter(F.transform(F.filter(parts, lambda p: ~F.coalesce(p["kind"].isin("thinking", "codeblockUri"), F.lit(False))), value), lambda x: x.isNotNull()), "")
    both = F.array(F.struct(F.lit(0).alias("o"), F.lit("user").alias("role"), said.alias("text")), F.struct(F.lit(1).alias("o"), F.lit("assistant").alias("role"), reply.alias("text")))
    return each.select("file", "i", F.col("r.requestId").alias("request_id"), F.col("r.timestamp").alias("timestamp_ms"), F.col("r.modelId").alias("model_id"), F.explode(both).alias("t")).select("file", (F.col("i") * 2 + F.col("t.o")).alias("turn"), "t.role", "request_id", "timestamp_ms", "model_id", "t.text")


def edit_baselines(baselines: DataFrame, final: DataFrame) -> DataFrame:
    """(resource, request_id, before_hash, after_hash) of edits: each baseline's content is what its request found, the next one's (or the final snapshot's) what it left.

    Equal or missing contents are no edits. baselines: (resource, request_id, epoch, hash); final: (resource, hash).
    """
    w = Window.partitionBy("resource").orderBy("epoch", "request_id")
    ended = final.select("resource", F.col("hash").alias("final_"))
    rows = baselines.withColumn("next_", F.lead("hash").over(w)).join(ended, "resource", "left").withColumn("after_hash", F.coalesce("next_", "final_"))
    return rows.where("hash is not null and after_hash is not null and hash != after_hash").select("resource", "request_id", F.col("hash").alias("before_hash"), "after_hash")


def folded_files(paths: Iterator[str]) -> list[str]:
    """Of files with one stem the .jsonl one, else the .json one, sorted."""
    chosen: dict[str, str] = {}
    for p in sorted(paths):
        stem = p.rsplit(".", 1)[0]
        if p.endswith(".jsonl") or stem not in chosen:
            chosen[stem] = p
    return sorted(chosen.values())


def attachments(rows: DataFrame) -> DataFrame:
    """(file, event_index, place, kind, path, title, media_type) of the files that events refer to, as texts or objects, in the event and in its message."""
    item = "struct<path:string,file_path:string,title:string,name:string,media_type:string,mime_type:string>"
    lists = [F.struct(F.lit(kind).alias("kind"), F.from_json(F.when(_get(at).startswith("["), _get(at)), "array<string>").alias("items")) for at, kind in (("attachment_refs", "attachment_refs"), ("attachments", "attachments"), ("message.attachment_refs", "attachment_refs"), ("message.attachments", "attachments"))]
    each = rows.where("valid").select("file", "event_index", F.posexplode(F.array(*lists)).alias("list", "l")).select("file", "event_index", "list", "l.kind", F.posexplode("l.items").alias("n", "item")).where("item is not null")
    of = F.from_json(F.when(F.col("item").startswith("{"), F.col("item")), item)
    first = lambda *names: F.coalesce(*[F.nullif(of[n], F.lit("")) for n in names], F.lit(""))
    plain = ~F.col("item").startswith("{")
    place = F.row_number().over(Window.partitionBy("file", "event_index").orderBy("list", "n")) - 1
    return each.select("file", "event_index", place.alias("place"), "kind", normal_path(F.when(plain, F.col("item")).otherwise(first("path", "file_path"))).alias("path"), F.when(plain, "").otherwise(first("title", "name")).alias("title"), F.when(plain, "").otherwise(first("media_type", "mime_type")).alias("media_type"))


def subagents(rows: DataFrame) -> DataFrame:
    """(file, tool_use_id, agent): the agent that each call started, told by queue and progress entries; the last one counts."""
    queued = (_get("type") == "queue-operation") & (_get("operation") == "enqueue")
    progress = (_get("type") == "progress") & (_get("data.type") == "agent_progress")
    of = lambda *paths: F.coalesce(*[F.nullif(_get(p), F.lit("")) for p in paths])
    parents = ("parentToolUseID", "parentToolUseId")
    task = F.coalesce(F.nullif(F.regexp_extract("line", r'(?i)"task[_-]?id"\s*:\s*"([^"]+)"', 1), F.lit("")), F.nullif(F.regexp_extract("line", r"agent-([A-Za-z0-9_-]+)", 1), F.lit("")))
    call = F.when(queued, of("tool_use_id", "toolUseId", *parents)).when(progress, of(*parents, *[f"data.{p}" for p in parents]))
    agent = F.when(queued, task).when(progress, of("data.agentId"))
    told = rows.where("valid").select("file", "event_index", call.alias("tool_use_id"), agent.alias("agent")).where("tool_use_id is not null and agent is not null")
    last = told.groupBy("file", "tool_use_id").agg(F.max_by("agent", "event_index").alias("agent"))
    return last.withColumn("agent", F.when(F.col("agent").startswith("agent-"), F.col("agent")).otherwise(F.concat(F.lit("agent-"), F.col("agent"))))


def session_metadata(rows: DataFrame) -> DataFrame:
    """(file, cwd, version, entrypoint, headless): the first given value of each in line order; a run by the SDK is headless."""
    first = lambda name: F.min_by(F.nullif(_get(name), F.lit("")), F.when(F.coalesce(_get(name), F.lit("")) != "", F.col("event_index"))).alias(name)
    each = rows.where("valid").groupBy("file").agg(first("cwd"), first("version"), first("entrypoint"))
    return each.withColumn("headless", F.coalesce(F.col("entrypoint") == "sdk-cli", F.lit(False)))


def thread_names(rows: DataFrame) -> DataFrame:
    """(id, thread_name) of the lines of a session index; the last one counts."""
    told = rows.where("valid").select("event_index", _get("id").alias("id"), _get("thread_name").alias("thread_name")).where("id != '' and thread_name != ''")
    return told.groupBy("id").agg(F.max_by("thread_name", "event_index").alias("thread_name"))


def attached_edits(events: DataFrame, edits: DataFrame) -> DataFrame:
    """events (session, event_index, role, request_id) with the edits (session, request_id, edits) of their request, at its first assistant event only."""
    first = events.where("role = 'assistant' and request_id != ''").groupBy("session", "request_id").agg(F.min("event_index").alias("event_index"))
    placed = edits.join(first, ["session", "request_id"]).select("session", "event_index", "edits")
    return events.join(placed, ["session", "event_index"], "left")
