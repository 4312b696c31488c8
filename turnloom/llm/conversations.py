"""Conversations from message rows: parent pointers resolved by pointer jumping, broken ones reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.operators.neighbours import previous_row
from turnloom.session import cut_lineage

#: Rows of one session that a window task sees at most (of turns that are whole numbers, each once).
SPAN = 4096
#: A character outside this class is visible.
_BLANK = r"\s\p{Z}\p{Cc}\p{Cf}͏ᅟᅠ឴឵᠋-᠏⠀ㅤ︀-️ﾠ"


def is_blank(text: Column) -> Column:
    """True for NULL and for text of white space and invisible characters only."""
    return ~F.coalesce(text.rlike(f"[^{_BLANK}]"), F.lit(False))


def speaker(role: Column) -> Column:
    """user, system or assistant from a role in any spelling; NULL for a NULL or blank one."""
    r = F.lower(F.regexp_replace(role, f"^[{_BLANK}]+|[{_BLANK}]+$", ""))
    return F.when(r.isin("user", "human"), "user").when(r == "system", "system").when(r != "", "assistant")


def resolve(nodes: DataFrame, node: str = "node", parent: str = "parent", max_rounds: int = 64) -> DataFrame:
    """(node, end, depth, state) of each node of a parent-pointer table, by pointer jumping.

    state is 'root' where the chain of parents ends at a node without one, 'orphan' where it ends at a
    parent that isn't there, 'cycle' where it doesn't end; end is the last node reached (NULL in a cycle)
    and depth the number of steps to it. Each round joins the open nodes with the pointers of the round
    before, which doubles the length of every pointer, so a chain of n rows takes log2(n) rounds; a node
    still open when the rounds have passed the number of nodes is in or above a cycle. Node ids must be
    unique. Rounds are cut by a reliable checkpoint; only (node, end, depth, open) are kept.
    """
    known = nodes.select(F.col(node).alias("node"), F.col(parent).alias("end_"))
    there = nodes.select(F.col(node).alias("there_"))
    start = known.join(there, F.col("end_") == F.col("there_"), "left").select(
        "node",
        F.when(F.col("there_").isNotNull(), F.col("end_")).otherwise(F.col("node")).alias("end"),
        F.when(F.col("there_").isNotNull(), 1).otherwise(0).cast("long").alias("depth"),
        F.when(F.col("there_").isNotNull(), F.lit("open")).when(F.col("end_").isNull(), "root").otherwise("orphan").alias("state"),
    )
    table = cut_lineage(start)
    total = table.count()
    for round_ in range(max_rounds):
        if table.where("state = 'open'").isEmpty():
            break
        if 2**round_ > total:
            return table.withColumns({"state": F.when(F.col("state") == "open", "cycle").otherwise(F.col("state")), "end": F.when(F.col("state") != "open", F.col("end")), "depth": F.when(F.col("state") != "open", F.col("depth"))})
        ahead = table.select(F.col("node").alias("at_"), F.col("end").alias("next_"), F.col("depth").alias("more_"), F.col("state").alias("then_"))
        jumped = table.join(ahead, (F.col("state") == "open") & (F.col("end") == F.col("at_")), "left")
        open_ = F.col("at_").isNotNull()
        table = cut_lineage(jumped.select("node", F.when(open_, F.col("next_")).otherwise(F.col("end")).alias("end"), (F.col("depth") + F.when(open_, F.col("more_")).otherwise(0)).alias("depth"), F.when(open_, F.col("then_")).otherwise(F.col("state")).alias("state")))
    return table


def distinct_messages(turns: DataFrame) -> DataFrame:
    """(session_id, turn, speaker, blank, text_hash, id, node, parent): rows equal in session, turn, role and text once (the least id stays).

    Texts stay where they are; a digest of each stands for it. node identifies the turn, and the
    parent is the turn before (NULL for turn 0, and for a NULL turn, which is at no place).
    """
    text = F.col("original_text")
    rows = turns.where("session_id is not null").select("session_id", "turn", "role", F.md5(text).alias("digest"), is_blank(text).alias("blank"), "id")
    once = rows.groupBy("session_id", "turn", "role", "digest").agg(F.min("id").alias("id"), F.first("blank").alias("blank"))
    at = lambda turn: F.when(turn.isNotNull(), F.xxhash64("session_id", turn.cast("long")))
    return once.select("session_id", "turn", speaker(F.col("role")).alias("speaker"), "blank", "id", at(F.col("turn")).alias("node"), F.when(F.col("turn") != 0, at(F.col("turn") - 1)).alias("parent"))


def session_states(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, sessions): the distinct messages, and (session_id, reason) with a NULL reason for whole sessions.

    * A session is broken unless each turn is there once, every turn's chain of parents ends at turn 0
      (no orphan, no cycle, no negative or NULL turn), every role is given and one is a user's.
    * no_reply looks, for each user row, at the row after it when system rows are left aside.
    * Rows without a session_id belong to no session. Empty tables give no sessions.
    """
    messages = cut_lineage(distinct_messages(turns))
    places = messages.where("node is not null").groupBy("node").agg(F.first("parent").alias("parent"), F.count(F.lit(1)).alias("n"), F.first("session_id").alias("session_id"), F.first("turn").alias("turn"))
    places = cut_lineage(places)
    chains = resolve(places)
    chained = places.join(chains, "node").groupBy("session_id").agg(
        F.bool_and((F.col("state") == "root") & (F.col("depth") == F.col("turn")) & (F.col("n") == 1)).alias("chained"),
    )
    talk = messages.where("speaker in ('user', 'assistant') and turn is not null").select("session_id", F.col("turn"), "speaker", "blank")
    # the row before each assistant row; a user row is answered if it is the row before an assistant row with text
    before = previous_row(talk, "session_id", F.floor(F.col("turn") / SPAN), ["turn"], F.struct("speaker", "turn"))
    answered = before.where("speaker = 'assistant' and not blank and previous.speaker = 'user'").groupBy("session_id").agg(F.count(F.lit(1)).alias("answered"))
    facts = messages.groupBy("session_id").agg(
        F.bool_and("blank").alias("empty"),
        F.bool_and(F.col("speaker").isNotNull() & F.col("turn").isNotNull()).alias("stated"),
        F.count_if(F.col("speaker") == "user").alias("users"),
        F.count(F.lit(1)).alias("rows"),
    )
    all_ = facts.join(chained, "session_id", "left").join(answered, "session_id", "left")
    broken = ~(F.col("stated") & F.coalesce("chained", F.lit(False)) & (F.col("users") > 0))
    reason = F.when(F.col("empty"), "empty").when(broken, "broken").when(F.col("users") > F.coalesce("answered", F.lit(0)), "no_reply")
    return messages, all_.select("session_id", "rows", reason.alias("reason"))


def dropped(turns: DataFrame) -> DataFrame:
    """(session_id, reason) of each session that isn't whole: empty, broken or no_reply, the first that holds."""
    return session_states(turns)[1].where("reason is not null").select("session_id", "reason")


def conversations(turns: DataFrame) -> DataFrame:
    """(session_id, position, speaker, text, messages): the whole sessions as root-to-leaf paths, a row per message.

    position counts from 0 along the path; messages is the length of the path. A path stays a set of
    rows, ordered by position: a session may be too long for one cell.
    """
    messages, sessions = session_states(turns)
    whole = sessions.where("reason is null").select("session_id", F.col("rows").alias("messages"))
    path = messages.join(whole, "session_id").select(F.col("id").alias("id_"), F.col("session_id").alias("session"), F.col("turn").alias("position"), "speaker", "messages")
    texts = turns.select("id", F.col("original_text").alias("text"))
    return texts.join(path, F.col("id") == F.col("id_")).select(F.col("session").alias("session_id"), "position", "speaker", "text", "messages")
