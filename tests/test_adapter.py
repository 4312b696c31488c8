import json
import random

from turnloom.operators import adapter as P

COLUMNS = [c.strip().split(" ")[0] for c in P.EVENT.replace("array<string>", "x").split(",")]


def event(session, index, role, text=None, id_=None, **more):
    row = dict.fromkeys(COLUMNS)
    row |= {"session": session, "event_index": index, "id": id_ if id_ is not None else index, "role": role, "text": text} | more
    return tuple(row[c] for c in COLUMNS)


def walk(events):
    """The rules as one walk over a session's events: (id, follow_up) of those that stay."""
    kept, caveat, seen = [], False, False
    for e in events:
        text = (e["text"] or "").strip().lower()
        results = bool(e["block_kinds"]) and set(e["block_kinds"]) <= set(P.RESULT_KINDS)
        quiet = (e["command"] or "").strip().lower().lstrip("/") in P.QUIET_COMMANDS
        after_assistant = bool(kept) and kept[-1][1] == "assistant"
        if e["role"] == "assistant":
            if seen:
                kept.append((e["id"], "assistant", False))
        elif e["role"] != "user":
            if e["has_results"] and seen and after_assistant:
                kept.append((e["id"], "other", True))
        elif e["is_meta"] and "<local-command-caveat>" in text:
            caveat = True
        elif text.startswith(("<local-command-stdout>", "<local-command-stderr>")) and (caveat or results):
            pass
        elif quiet:
            pass
        elif results:
            if seen and after_assistant:
                kept.append((e["id"], "user", True))
        else:
            caveat, seen = False, True
            kept.append((e["id"], "user", False))
    return [(i, f) for i, _, f in kept]


def some_events(seed, n=400):
    r = random.Random(seed)
    out = []
    for i in range(n):
        role = r.choice(["user", "user", "assistant", "assistant", "assistant", "tool", "system", None])
        text = r.choice(["hello", "more", "", None, "  <local-command-stdout>done", "<Local-Command-Caveat>typed", "<local-command-stderr>no"])
        out.append(event(f"s{r.randrange(6)}", r.randrange(40), role, text, id_=i, is_meta=r.choice([True, True, False, None]), command=r.choice([None, None, None, "/clear", "effort", "review"]), block_kinds=r.choice([None, [], ["text"], ["tool_result"], ["tool_result", "mcp_tool_result"], ["tool_result", "text"]]), has_results=r.choice([True, False, None])))
    return out


def test_conversation_events_against_a_walk(spark, monkeypatch):
    monkeypatch.setattr(P, "SPAN", 7)
    for seed in (1, 2):
        rows = some_events(seed)
        want = set()
        for s in {x[0] for x in rows}:
            own = sorted((dict(zip(COLUMNS, x)) for x in rows if x[0] == s), key=lambda e: (e["event_index"], e["id"]))
            want |= set(walk(own))
        df = spark.createDataFrame(rows, P.EVENT)
        got = [(r.id, r.follow_up) for r in P.conversation_events(df).select("id", "follow_up").collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_turns(spark):
    result = {"block_kinds": ["tool_result"], "request_id": "r3", "model_id": "late", "file_paths": ["z.py"], "timestamp_ms": 1, "input_tokens": 4, "tool_names": ["Hidden"]}
    rows = [
        event("s", 0, "assistant", "before any user"),
        event("s", 1, "user", "<x>", command="review", command_text="/review a", timestamp_ms=50, timestamp_iso="iso50", request_id="r0"),
        event("s", 2, "assistant", "ignored", block_kinds=["thinking", "text", "text"], block_texts=["hm", "Run", "ning"], thinking_text=" hm ", request_id="r1", timestamp_ms=70, timestamp_iso="iso70", model_id="", input_tokens=100, output_tokens=25, tool_names=["Write", "Task"], file_paths=["b.py", "a.py"]),
        event("s", 3, "user", None, **result),
        event("s", 4, "assistant", "Done ", request_id="r2", timestamp_ms=60, timestamp_iso="iso60", model_id="m", input_tokens=10, output_tokens=5, tool_names=["Task"]),
        event("s", 5, "user", None),
        event("t", 0, "assistant", "alone"),
        event(None, 0, "user", "nowhere"),
    ]
    got = {(r.session, r.turn): r for r in P.turns_of(spark.createDataFrame(rows, P.EVENT)).collect()}
    assert set(got) == {("s", 0), ("s", 1), ("s", 2)}
    user, reply, last = got["s", 0], got["s", 1], got["s", 2]
    assert (user.role, user.text, user.request_id, user.timestamp_iso, user.token_usage) == ("user", "/review a", "r0", "iso50", None)
    assert (reply.role, reply.text, reply.thinking_text, reply.timestamp_ms, reply.timestamp_iso) == ("assistant", "Running\n\nDone", "hm", 60, "iso60")
    assert (reply.request_ids, reply.model_id, reply.files, reply.tools, reply.events) == (["r1", "r3", "r2"], "late", ["a.py", "b.py", "z.py"], ["Task", "Write"], 3)
    assert json.loads(reply.token_usage) == {"input_tokens": 114, "output_tokens": 30}
    assert (last.role, last.text, last.files) == ("user", "", [])
    assert P.turns_of(spark.createDataFrame([], P.EVENT)).count() == 0


def test_code_edits(spark):
    rows = [
        (1, "Write", '{"file_path": "a.py", "content": "x\\ny"}', None, None), (2, "edit", '{"path": "b.py", "old_string": "1", "new_string": "2"}', '["c.py"]', None), (3, "ApplyPatch", "{}", None, '{"changes": {"d.py": {"unified_diff": "+x\\n-y"}, "": {"unified_diff": "+"}}}'),
        (4, "Write", "{cut", '["e.py"]', None), (5, "Write", "{}", "[]", None), (6, "Bash", '{"file_path": "f"}', None, None), (7, None, None, None, None), (8, "Edit", '{"file_path": "g.py"}', "{}", "not json"),
    ]
    df = spark.createDataFrame(rows, "id long, name string, arguments string, file_paths string, raw string")
    got = sorted(tuple(r) for r in P.code_edits(df).collect())
    assert got == [(1, "a.py", None, "x\ny", None), (2, "c.py", "1", "2", None), (3, "d.py", None, None, "+x\n-y"), (4, "e.py", None, "", None), (8, "g.py", "", "", None)]


def test_predicates(spark):
    df = spark.createDataFrame([("<command-name> /review </command-name><command-args>a b</command-args>",), ("<command-name>clear</command-name>",), ("plain",), (None,), ("<command-name></command-name>",)], "t string")
    assert [(r.c.name, r.c.args, r.c.text) if r.c else None for r in df.select(P.command_of(df.t).alias("c")).collect()] == [("/review", "a b", "/review a b"), ("clear", "", "/clear"), None, None, None]
    df = spark.createDataFrame([("x", None, None, None), (" ", "", [], []), (None, None, ["Bash"], None), (None, None, None, ["f"])], "a string, b string, c array<string>, d array<string>")
    assert [r[0] for r in df.select(P.meaningful(df.a, df.b, df.c, df.d)).collect()] == [True, False, True, True]
