import json

from pyspark.sql import functions as F

from turnloom.operators.store import latest, replace_partitions
from turnloom.sources import logs as L
from turnloom.streaming import ingest


def write(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_tree_events(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", [
        {"type": "user", "uuid": "1", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": "hello"}}, "", "{broken", "[1]",
        {"type": "assistant", "uuid": "2", "parentUuid": "1", "message": {"role": "assistant", "model": "m", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "a"}, {"type": "text", "text": "b"}, {"type": "tool_use", "name": "Read"}], "usage": {"input_tokens": 3, "output_tokens": 4}}},
    ])
    rows = L.lines(spark, path)
    assert [r.line_number for r in L.issues(rows).orderBy("line_number").collect()] == [3, 4]
    a, b = L.tree_events(rows).orderBy("event_index").collect()
    assert (a.role, a.text, a.tool_names) == ("user", "hello", [])
    assert (b.text, b.thinking_text, b.tool_names, b.input_tokens, b.parent_id, b.model_id) == ("a\nb", "hm", ["Read"], 3, "1", "m")


def test_rollout_and_command_line(spark, tmp_path):
    path = write(tmp_path / "r.jsonl", [
        {"type": "session_meta", "payload": {"id": "s"}}, {"type": "turn_context", "payload": {"model": "x"}}, {"type": "event_msg", "payload": {"type": "user_message", "message": "q"}},
        {"type": "event_msg", "payload": {"type": "token_count"}}, {"type": "event_msg", "payload": {"type": "exec_command_begin", "call_id": "c"}}, {"type": "event_msg", "payload": {"type": "agent_message", "message": "w"}},
    ])
    got = [(r.role, r.text, r.model_id, r.tool_names) for r in L.rollout_events(L.lines(spark, path)).orderBy("event_index").collect()]
    assert got == [("user", "q", "x", None), ("assistant", None, "x", ["Bash"]), ("assistant", "w", "x", None)]
    path = write(tmp_path / "c.jsonl", [
        {"type": "session.start", "data": {"sessionId": "s", "selectedModel": "m1"}}, {"type": "user.message", "data": {"content": "q"}}, {"type": "session.model_change", "data": {"newModel": "m2"}},
        {"type": "assistant.message", "data": {"content": "w", "toolRequests": [{"name": "bash"}]}},
    ])
    got = [(r.role, r.text, r.model_id, r.session_id, r.tool_names) for r in L.command_line_events(L.lines(spark, path)).orderBy("event_index").collect()]
    assert got == [("user", "q", None, "s", None), ("assistant", "w", "m2", "s", ["bash"])]


def test_delta_log(spark, tmp_path):
    path = write(tmp_path / "log.jsonl", [
        {"kind": 0, "v": {"title": "t", "requests": []}}, "not json",
        {"kind": 2, "k": ["requests"], "v": [{"requestId": "first", "timestamp": 1700, "message": {"text": "why?"}, "response": []}]},
        {"kind": 2, "k": ["requests", 0, "response"], "v": [{"kind": "thinking", "value": "hm"}, {"value": "be"}]}, {"kind": 7, "k": ["title"], "v": "no"},
        {"kind": 2, "k": ["requests", 0, "response"], "v": [{"value": "cause"}]}, {"kind": 1, "k": ["requests", 0, "modelId"], "v": "larch"},
    ])
    turns = L.chat_turns(L.delta_documents(L.lines(spark, path))).orderBy("turn").collect()
    assert [(t.turn, t.role, t.text, t.model_id, t.timestamp_ms) for t in turns] == [(0, "user", "why?", "larch", 1700), (1, "assistant", "because", "larch", 1700)]
    assert L.folded_files(iter(["a.json", "a.jsonl", "b.json"])) == ["a.jsonl", "b.json"]


def test_line_numbers_over_splits(spark, tmp_path):
    """A file read in many splits has the line numbers of the whole, blank lines counted."""
    text = ["" if i % 11 == 3 else json.dumps({"n": i, "x": "y" * (i % 40)}) for i in range(900)]
    path = write(tmp_path / "long.jsonl", text)
    write(tmp_path / "other.jsonl", [{"n": 0}, {"n": 1}])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = L.lines(spark, [path, str(tmp_path / "other.jsonl")])
        assert spark.read.text(path).rdd.getNumPartitions() > 4
        rows = [(r.file[-10:], r.event_index, json.loads(r.line)["n"]) for r in got.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(i for f, i, n in rows if f == "long.jsonl"[-10:]) == [i for i in range(900) if i % 11 != 3]
    assert all(i == n for _, i, n in rows) and len(rows) == 2 + len([t for t in text if t])


def test_replay():
    start = {"kind": 0, "v": {"requests": [], "n": 1}}
    say = lambda *more: L.replayed([start, *more])
    assert L.replayed([]) == L.replayed([{"kind": 0, "v": 3}]) == {"requests": []}
    assert L.replayed([{"kind": 1, "k": ["n"], "v": 2}, {"kind": 1, "k": ["m"], "v": 3}]) == {"m": 3, "requests": []}  # the first entry is only a start
    assert say({"kind": 1, "k": ["requests", 2, "a"], "v": 5}) == {"requests": [{}, {}, {"a": 5}], "n": 1}
    assert say({"kind": 2, "k": ["requests", 1], "v": [4]}) == {"requests": [[], [4]], "n": 1}
    assert say({"kind": 1, "k": ["requests", "0"], "v": 5}) == say({"kind": 2, "k": ["requests"], "v": 5}) == say({"kind": 2, "k": ["n"], "v": [5]}) == say({"kind": 1, "k": [], "v": 5}) == say(start) == start["v"]
    assert say({"kind": 2, "k": ["x", "y"], "v": [1]}, {"kind": 1, "k": ["x", "0"], "v": 2}) == {"requests": [], "n": 1, "x": {"y": [1], "0": 2}}


def test_details_of_message_logs(spark, tmp_path):
    path = write(tmp_path / "m.jsonl", [
        {"type": "user", "cwd": "", "attachments": ["C:\\a.txt", {"file_path": "b.md", "name": "B", "mime_type": "text/markdown"}], "message": {"attachment_refs": [{"path": "/c"}]}}, {"type": "assistant", "cwd": "/w", "version": "2", "entrypoint": "sdk-cli"},
        {"type": "queue-operation", "operation": "enqueue", "toolUseId": "t1", "content": "<x> agent-77 </x>"}, {"type": "queue-operation", "operation": "enqueue", "tool_use_id": "t2", "task_id": "9"}, {"type": "progress", "data": {"type": "agent_progress", "agentId": "agent-5", "parentToolUseID": "t2"}},
        {"type": "progress", "parentToolUseID": "t3", "data": {"type": "other", "agentId": "1"}}, {"type": "queue-operation", "operation": "dequeue", "toolUseId": "t4", "task_id": "1"}, {"type": "user", "cwd": "/later"},
    ])
    rows = L.lines(spark, path)
    assert sorted(tuple(r)[1:] for r in L.attachments(rows).collect()) == [(0, 0, "attachments", "c:/a.txt", "", ""), (0, 1, "attachments", "b.md", "B", "text/markdown"), (0, 2, "attachment_refs", "/c", "", "")]
    assert {r.tool_use_id: r.agent for r in L.subagents(rows).collect()} == {"t1": "agent-77", "t2": "agent-5"}
    assert [tuple(r)[1:] for r in L.session_metadata(rows).collect()] == [("/w", "2", "sdk-cli", True)]
    index = L.lines(spark, write(tmp_path / "i.jsonl", [{"id": "a", "thread_name": "one"}, {"id": "a", "thread_name": "two"}, {"id": "b", "thread_name": ""}, {"id": "", "thread_name": "x"}]))
    assert dict(L.thread_names(index).collect()) == {"a": "two"}


def test_attached_edits(spark):
    events = spark.createDataFrame([("s", 0, "user", "r"), ("s", 1, "assistant", "r"), ("s", 2, "assistant", "r"), ("s", 3, "assistant", "q")], "session string, event_index int, role string, request_id string")
    edits = spark.createDataFrame([("s", "r", ["e1"]), ("t", "q", ["e2"])], "session string, request_id string, edits array<string>")
    assert {r.event_index: r.edits for r in L.attached_edits(events, edits).collect()} == {0: None, 1: ["e1"], 2: None, 3: None}


def test_edit_baselines(spark):
    base = spark.createDataFrame([("f", "r1", 1, "h1"), ("f", "r2", 2, "h2"), ("f", "r3", 3, "h2"), ("g", "r1", 1, "h9")], "resource string, request_id string, epoch int, hash string")
    final = spark.createDataFrame([("f", "h4")], "resource string, hash string")
    assert sorted(tuple(r) for r in L.edit_baselines(base, final).collect()) == [("f", "r1", "h1", "h2"), ("f", "r3", "h2", "h4")]


def test_stream_takes_each_file_once(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    line = lambda i, s: {"sessionId": s, "uuid": str(i), "role": "user", "timestamp": f"2024-01-01T00:0{i}:00Z", "content": "x"}
    write(folder / "1.jsonl", [line(1, "a"), line(2, "b"), {"note": 1}])

    def sink(df, _):
        if not df.isEmpty():
            replace_partitions(df.select("event_id", "role", "session_id"), str(out), "session_id")

    run = lambda: ingest.upserting(ingest.events(ingest.tailed(spark, str(folder))), sink, str(tmp_path / "check")).awaitTermination(60)
    run()
    assert sorted(r.event_id for r in spark.read.parquet(str(out)).collect()) == ["1", "2"]
    write(folder / "2.jsonl", [line(3, "b")])
    run()
    assert sorted((r.session_id, r.event_id) for r in spark.read.parquet(str(out)).collect()) == [("a", "1"), ("b", "3")]


def test_windows_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", f"2024-01-01 00:{m:02}:00") for m in (1, 2, 31, 59)] + [("a", "2024-01-02 00:00:00")], "k string, t string").select("k", F.to_timestamp("t").alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "p"))
    q = ingest.tumbling(stream, "30 minutes", "k").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.rows for r in spark.table("tumbled").collect()) == [1, 2, 2]
    assert sorted(r.rows for r in ingest.sessions(rows, "10 minutes", "k").collect()) == [1, 1, 1, 2]


def test_latest(spark):
    df = spark.createDataFrame([("s", 1, 1, "old"), ("s", 1, 5, "new"), ("t", 1, 2, None)], "s string, t int, id int, v string")
    assert sorted(tuple(r) for r in latest(df, ["s", "t"], "id").collect()) == [("s", 1, 5, "new"), ("t", 1, 2, None)]
