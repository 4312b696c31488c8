"""Turns made richer: edits chained, models defaulted, calls matched with results, forks split."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.operators.neighbours import previous_row, running


def chained_edits(edits: DataFrame) -> DataFrame:
    """edits with an empty before replaced by the after of the edit before it of the same file.

    edits: (workspace, agent, session, file, at, ord, before, after). The order is (at, ord); a file's first edit
    keeps what it has. The file is keyed with its session, so a busy session is spread over its files.
    """
    keyed = edits.withColumn("file_key_", F.xxhash64("workspace", "agent", "session", "file"))
    rows = previous_row(keyed, "file_key_", F.floor(F.col("at") / 86_400_000), ["at", "ord"], F.struct("after"))
    return rows.withColumn("before", F.when(F.coalesce("before", F.lit("")) == "", F.coalesce("previous.after", "before")).otherwise(F.col("before"))).drop("previous", "file_key_")


def defaulted_models(turns: DataFrame, timeline: DataFrame) -> DataFrame:
    """turns with a NULL or '' model replaced by the agent's default of the last date up to the turn's day.

    turns: (id, agent, day, model_id); timeline: (agent, since, model). The as-of look-up is a running maximum
    over turns and dates together, so it needs no range join. Without an earlier date the model stays empty.
    """
    own = turns.select("id", "agent", "day", "model_id", F.lit(1).alias("late"), F.lit(None).cast("struct<since:date,model:string>").alias("given"))
    dates = timeline.select(F.lit(None).cast("bigint").alias("id"), "agent", F.col("since").alias("day"), F.lit(None).cast("string").alias("model_id"), F.lit(0).alias("late"), F.struct(F.col("since").alias("since"), F.col("model").alias("model")).alias("given"))
    rows = running(own.unionByName(dates), "agent", F.year("day"), ["day", "late", "id"], maxes={"asof": F.col("given")}).where("late = 1")
    empty = F.coalesce("model_id", F.lit("")) == ""
    return rows.select("id", "agent", "day", F.when(empty, F.coalesce("asof.model", "model_id")).otherwise(F.col("model_id")).alias("model_id"))


def matched_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(event, call_index, call_id, results, first_result, status) of each call with its results.

    calls: (event, call_index, call_id); results: (event, result_index, call_id, status, is_error). The results with
    the call's id count; where there are none, the call at position n takes the n-th of the results of its event
    that have no id (NULL or ''). The status is the first stated one, else error if any result is one, else success
    if there is a result, else unknown. Positions are numbered within an event, which holds the calls of one turn.
    """
    w = lambda i: Window.partitionBy("event").orderBy(i)
    stated = F.when(F.coalesce("status", F.lit("unknown")).isin("unknown", ""), None).otherwise(F.struct("result_index", "status"))
    summed = [F.count(F.lit(1)).alias("results"), F.min("result_index").alias("first_result"), F.min(stated)["status"].alias("stated"), F.bool_or(F.coalesce("is_error", F.lit(False))).alias("failed")]
    given = F.coalesce("call_id", F.lit("")) != ""
    named = results.where(given).groupBy("event", "call_id").agg(*summed)
    loose = results.where(~given).withColumn("pos_", F.row_number().over(w("result_index"))).groupBy("event", "pos_").agg(*summed)
    part = lambda df, name: df.withColumn(name, F.struct("results", "first_result", "stated", "failed")).drop("results", "first_result", "stated", "failed")
    rows = calls.withColumn("pos_", F.row_number().over(w("call_index"))).join(part(named, "r1"), ["event", "call_id"], "left").join(part(loose, "r2"), ["event", "pos_"], "left")
    rows = rows.withColumn("r", F.coalesce("r1", "r2"))
    status = F.coalesce("r.stated", F.when(F.col("r.failed"), "error"), F.when(F.col("r").isNotNull(), "success"), F.lit("unknown"))
    return rows.select("event", "call_index", "call_id", F.coalesce("r.results", F.lit(0)).alias("results"), F.col("r.first_result").alias("first_result"), status.alias("status"))


def inferred_parents(children: DataFrame, turns: DataFrame) -> DataFrame:
    """(child, parent_session, parent_turn): the parent's last turn at or before a child session's start, else its last turn.

    children: (child, parent_session, started); turns: (session, turn, at), the assistant turns of the parents. Turns
    without a time come first and count only as the last one. Children of sessions without turns have no row.
    """
    own = children.select(F.col("parent_session").alias("session"), "child", F.col("started").alias("at"), F.lit(None).cast("int").alias("turn"), F.lit(1).alias("late"))
    both = own.where("at is not null").unionByName(turns.where("at is not null").select("session", F.lit(None).cast("string").alias("child"), "at", "turn", F.lit(0).alias("late")))
    rows = running(both, "session", F.floor(F.col("at") / 86_400_000), ["at", "late", "turn", "child"], maxes={"call": F.when(F.col("late") == 0, F.struct("at", "turn"))}).where("late = 1")
    rows = rows.select("child", "session", "call.turn").unionByName(own.where("at is null").select("child", "session", "turn"))
    last = turns.groupBy("session").agg(F.max_by("turn", F.struct(F.coalesce("at", F.lit(0).cast("bigint")), "turn")).alias("last_"))
    return rows.join(last, "session").select("child", F.col("session").alias("parent_session"), F.coalesce("turn", "last_").alias("parent_turn"))


def subagent_rows(children: DataFrame, turns: DataFrame, calls: DataFrame, links: DataFrame) -> DataFrame:
    """(session, turn, child, source_call_id, source_tool, relationship_type, subagent_index): where each child session was started.

    children: (child, parent_session, started, relationship_type); turns: (session, turn, at), assistant turns; calls:
    (session, turn, call_index, call_id, name, spawned); links: (session, turn, link_index, target, call_id, name). A
    call that names the child decides, the last one of several; then the first link; else the turn is inferred from the times.
    The children of a turn are numbered from 0 by their start and id.
    """
    by_call = calls.where(F.coalesce("spawned", F.lit("")) != "").groupBy(F.col("session").alias("parent_session"), F.col("spawned").alias("child")).agg(F.max_by(F.struct("turn", "call_id", "name"), F.struct("turn", "call_index")).alias("c"))
    by_link = links.where(F.coalesce("target", F.lit("")) != "").groupBy(F.col("session").alias("parent_session"), F.col("target").alias("child")).agg(F.min_by(F.struct("turn", "call_id", "name"), F.struct("turn", "link_index")).alias("l"))
    own = children.where("parent_session != ''")
    rows = own.join(by_call, ["parent_session", "child"], "left").join(by_link, ["parent_session", "child"], "left").withColumn("e", F.coalesce("c", "l"))
    open_ = rows.where("e is null")
    guessed = inferred_parents(open_.select("child", "parent_session", "started"), turns)
    told = rows.where("e is not null").select("parent_session", F.col("e.turn").alias("turn"), "child", "started", F.coalesce("e.call_id", F.lit("")).alias("source_call_id"), F.coalesce("e.name", F.lit("")).alias("source_tool"), F.lit("subagent").alias("relationship_type"))
    rest = guessed.join(open_.select("child", "parent_session", "started", "relationship_type"), ["child", "parent_session"]).select("parent_session", F.col("parent_turn").alias("turn"), "child", "started", F.lit("").alias("source_call_id"), F.lit("").alias("source_tool"), F.coalesce(F.nullif("relationship_type", F.lit("")), F.lit("subagent")).alias("relationship_type"))
    index = F.row_number().over(Window.partitionBy("parent_session", "turn").orderBy(F.coalesce("started", F.lit(0).cast("bigint")), "child")) - 1
    return told.unionByName(rest).select(F.col("parent_session").alias("session"), "turn", "child", "source_call_id", "source_tool", "relationship_type", index.alias("subagent_index"))


#: Fixed value: user turns in a branch beyond which a fork is split.
FORK_TURNS = 3


def branches_of(nodes: list[tuple[str | None, str | None, str, int]], fork_turns: int = FORK_TURNS) -> list[tuple[str, list[int]]]:
    """The branches (branch id, positions of its messages) of messages (id, parent, type, line); the main one has the id ''.

    At a message with several children the last one carries on alone, unless a child has more than fork_turns user
    messages from itself down: then every child becomes a branch with all that led to it. The first child stays
    in the branch it is in; of the main branch the others are named by their first message. Messages without an id,
    ids given twice, an unknown parent, and no single root make one branch of all messages as they stand.
    """
    line = [("", list(range(len(nodes))))]
    at = {n[0]: i for i, n in enumerate(nodes) if n[0]}
    roots = [i for i, n in enumerate(nodes) if not n[1]]
    if len(at) != len(nodes) or len(roots) != 1 or any(n[1] and n[1] not in at for n in nodes):
        return line if nodes else []
    children: list[list[int]] = [[] for _ in nodes]
    for i in sorted(range(len(nodes)), key=lambda i: nodes[i][3]):
        if nodes[i][1]:
            children[at[nodes[i][1]]].append(i)
    reached, stack = [], [roots[0]]
    while stack:
        i = stack.pop()
        reached.append(i)
        stack += children[i]
    users = [0] * len(nodes)
    for i in reversed(reached):
        users[i] = (nodes[i][2] == "user") + sum(users[c] for c in children[i])
    out: list[tuple[str, list[int]]] = []
    todo = [(roots[0], [], "")]
    while todo:
        i, before, name = todo.pop()
        path = [*before, i]
        while children[i] and max(users[c] for c in children[i]) <= fork_turns or len(children[i]) == 1:
            i = children[i][-1]
            path.append(i)
        if not children[i]:
            out.append((name, path))
        else:
            todo += [(c, path, name or (nodes[c][0] if n else "")) for n, c in reversed(list(enumerate(children[i])))]
    return out


def split_forks(events: DataFrame) -> DataFrame:
    """(session_id, branch, branch_id, position, message_id): the messages of each branch of each session in order; see branches_of.

    events: (session_id, message_id, parent_id, event_type, event_index). Rows without a session are left out. A
    session's tree is one task's work, of its ids and types only; texts are joined by message_id afterwards.
    """

    def split(df: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(df["event_index"], df["message_id"], df["parent_id"], df["event_type"]), key=lambda r: r[0])
        nodes = [(m if isinstance(m, str) else None, p if isinstance(p, str) and p else None, t, int(i)) for i, m, p, t in rows]
        out = [(b, name, n, nodes[i][0]) for b, (name, path) in enumerate(branches_of(nodes)) for n, i in enumerate(path)]
        return pd.DataFrame({"session_id": df["session_id"].iloc[0], "branch": [r[0] for r in out], "branch_id": [r[1] for r in out], "position": [r[2] for r in out], "message_id": [r[3] for r in out]})

    rows = events.where("session_id is not null").select("session_id", "message_id", "parent_id", "event_type", "event_index")
    return rows.groupBy("session_id").applyInPandas(split, "session_id string, branch int, branch_id string, position int, message_id string")
