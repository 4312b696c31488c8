from datetime import date

import pytest

from turnloom.functions import shrink as K
from turnloom.operators import enrich as E
from turnloom.plans import catalogue, views
from turnloom.sources.code import ignore_rule, ignored, lines_of_code
from turnloom.sources.tables import table


def test_chained_edits(spark):
    rows = [("w", "a", "s", "f", 1, 0, "", "one"), ("w", "a", "s", "f", 200_000_000, 0, None, "two"), ("w", "a", "s", "g", 3, 0, "", "x"), ("w", "a", "s", "f", 300_000_000, 0, "own", "three")]
    df = spark.createDataFrame(rows, "workspace string, agent string, session string, file string, at long, ord int, before string, after string")
    got = {(r.file, r.at): r.before for r in E.chained_edits(df).collect()}
    assert got == {("f", 1): "", ("f", 200_000_000): "one", ("g", 3): "", ("f", 300_000_000): "own"}


def test_defaulted_models(spark):
    turns = spark.createDataFrame([(1, "a", date(2024, 1, 1), None), (2, "a", date(2024, 3, 1), ""), (3, "a", date(2025, 6, 1), None), (4, "a", date(2024, 3, 1), "own"), (5, "b", date(2024, 3, 1), None)], "id long, agent string, day date, model_id string")
    dates = spark.createDataFrame([("a", date(2024, 3, 1), "m1"), ("a", date(2024, 5, 1), "m2")], "agent string, since date, model string")
    assert {r.id: r.model_id for r in E.defaulted_models(turns, dates).collect()} == {1: None, 2: "m1", 3: "m2", 4: "own", 5: None}


def test_matched_results(spark):
    calls = spark.createDataFrame([(1, 0, "x"), (1, 1, None), (1, 2, "z"), (2, 0, "q"), (3, 5, ""), (3, 7, "k")], "event int, call_index int, call_id string")
    results = spark.createDataFrame([(1, 0, None, None, True), (1, 1, "x", "success", False), (1, 2, "", "unknown", None), (1, 3, "x", "late", None), (3, 0, None, None, None), (3, 1, None, "done", True), (3, 2, "gone", None, None)], "event int, result_index int, call_id string, status string, is_error boolean")
    got = {(r.event, r.call_index): (r.results, r.first_result, r.status) for r in E.matched_results(calls, results).collect()}
    assert got == {(1, 0): (2, 1, "success"), (1, 1): (1, 2, "success"), (1, 2): (0, None, "unknown"), (2, 0): (0, None, "unknown"), (3, 5): (1, 0, "success"), (3, 7): (1, 1, "done")}
    assert E.matched_results(calls.limit(0), results).count() == 0


def test_inferred_parents(spark):
    children = spark.createDataFrame([("c1", "s", 5), ("c2", "s", 500_000_000), ("c3", "s", 1), ("c4", "none", 1), ("c5", "s", None)], "child string, parent_session string, started long")
    turns = spark.createDataFrame([("s", 1, 2), ("s", 2, 5), ("s", 9, 400_000_000), ("s", 11, None)], "session string, turn int, at long")
    assert {r.child: r.parent_turn for r in E.inferred_parents(children, turns).collect()} == {"c1": 2, "c2": 9, "c3": 9, "c5": 9}


def test_subagent_rows(spark):
    children = spark.createDataFrame([("a", "s", 9, None), ("b", "s", 3, "fork"), ("c", "s", 4, ""), ("d", "s", 1, "x"), ("e", None, 1, "x")], "child string, parent_session string, started long, relationship_type string")
    turns = spark.createDataFrame([("s", 1, 2), ("s", 5, 8)], "session string, turn int, at long")
    calls = spark.createDataFrame([("s", 1, 0, "k0", "Task", "a"), ("s", 5, 0, "k1", "Task", "a"), ("s", 1, 1, "k2", "Task", None)], "session string, turn int, call_index int, call_id string, name string, spawned string")
    links = spark.createDataFrame([("s", 1, 0, "a", "l0", "T"), ("s", 5, 1, "d", "l1", "T")], "session string, turn int, link_index int, target string, call_id string, name string")
    got = {r.child: tuple(r)[1:] for r in E.subagent_rows(children, turns, calls, links).select("child", "turn", "source_call_id", "relationship_type", "subagent_index").collect()}
    assert got == {"a": (5, "k1", "subagent", 1), "d": (5, "l1", "subagent", 0), "b": (1, "", "fork", 0), "c": (1, "", "subagent", 1)}


def test_forks(spark):
    whole = lambda nodes: [("", list(range(len(nodes))))]
    line = [("a", None, "user", 0), ("b", "a", "assistant", 1), ("c", "b", "user", 2)]
    assert E.branches_of(line) == whole(line) and E.branches_of([]) == []
    retry = [*line, ("c2", "b", "user", 3), ("d2", "c2", "assistant", 4)]
    assert E.branches_of(retry) == [("", [0, 1, 3, 4])]
    long = [("r", None, "user", 0), ("s", "r", "user", 40), ("y", "r", "user", 50)] + [(f"x{i}", f"x{i - 1}" if i else "r", "user", i + 1) for i in range(5)]
    assert E.branches_of(long) == [("", [0, 3, 4, 5, 6, 7]), ("s", [0, 1]), ("y", [0, 2])]
    inner = [*long, *[(f"z{i}", f"z{i - 1}" if i else "y", "user", 60 + i) for i in range(4)], ("w", "y", "assistant", 99)]
    assert [b for b, _ in E.branches_of(inner)] == ["", "s", "y", "y"] and E.branches_of(inner)[3][1] == [0, 2, 12]
    for broken in ([("a", "gone", "user", 0)], [("a", None, "user", 0), ("b", None, "user", 1)], [("a", None, "user", 0), ("a", None, "user", 1)], [(None, None, "user", 0), ("b", None, "user", 1)]):
        assert E.branches_of(broken) == whole(broken)
    beside = [("a", None, "user", 0), ("b", "c", "user", 1), ("c", "b", "user", 2)]
    assert E.branches_of(beside) == [("", [0])]  # a cycle beside the root is reached by nothing
    deep = [(str(i), str(i - 1) if i else None, "user", i) for i in range(20_000)]
    assert E.branches_of(deep) == whole(deep)
    df = spark.createDataFrame([("s", *n) for n in long] + [(None, "q", None, "user", 0)], "session_id string, message_id string, parent_id string, event_type string, event_index int")
    got = sorted((r.branch, r.branch_id, r.position, r.message_id) for r in E.split_forks(df).collect())
    assert [g[3] for g in got] == ["r", "x0", "x1", "x2", "x3", "x4", "r", "s", "r", "y"] and {g[:2] for g in got} == {(0, ""), (1, "s"), (2, "y")}


def test_shrink(spark):
    prose = "This is a sentence about the matter at hand.\n" * 20
    code = "\n".join(f"    x{i} = call({i});" for i in range(100))
    text = prose + code + "\n" + prose
    short = K.shrunk(text)
    assert short.startswith(prose) and short.endswith(prose) and "lines ...]" in short and len(short) < len(text) - 1000
    assert K.shrunk("short") == "short" and K.shrunk(None) is None and K.shrunk("") == ""
    assert [K.line_kind(x) for x in ("2024-01-01 10:00:00 INFO x", "def f(x):", "A plain sentence stands here.", "")] == ["logs", "code", "text", "none"]
    log = "\n".join(f"2024-01-01 10:00:{i:02} INFO step" for i in range(20))
    assert K.cut_repeats(log).split("\n")[2] == "[... 16 lines ...]" and len(K.cut_repeats(log).split("\n")) == 5
    assert K.diff_counts("a\nb\nc", "a\nx\nc\nd") == (2, 1) and K.diff_counts(None, "a") == (1, 0)
    assert K.code_measure("def f(a):\n    # note\n\n    if a and b:\n        return 1\n")[:2] == (3, 3.0) and K.code_measure(" ") == (0, 0.0, 0)
    df = spark.createDataFrame([("a\n", "a\nif x:\n"), (None, None)], "b string, a string")
    got = df.select(K.edit_metrics(df.b, df.a).alias("m"), K.shrunk_column(df.a).alias("s"), K.without_logs(df.a).alias("l")).collect()
    assert [tuple(r.m) for r in got] == [(1, 0, 1, 1.0), (0, 0, 0, 0.0)]


def test_lines_of_code(spark, tmp_path):
    for name, body in {"a.py": "x = 1\n\ny = 2\n", "docs/r.md": "# t\ntext\n", "build/b.py": "z\n", "build/keep.py": "k\n", "c.bin": "q"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    got = {(r.kind, r.ending): (r.files, r.lines) for r in lines_of_code(spark, str(tmp_path), "# rules\nbuild/*.py\n!keep.py\n").collect()}
    assert got == {("code", "py"): (2, 3), ("document", "md"): (1, 2)}
    rules = [ignore_rule(x) for x in ("/top", "**/deep/*.log", "dir/")]
    assert ignored("top", rules) and not ignored("a/top", rules) and ignored("a/deep/x.log", rules) and ignored("dir/x", rules) and not ignored("dir", rules)


def test_views(spark, small):
    assert catalogue.QUERIES and views.checked() == []
    assert views.checked((views.Dashboard("d", "t", (views.Part("a", "none"), views.Part("a", "a01_system_stats", "odd"))),)) == ["d: a is given twice", "d.a: no query none", "d.a: no chart odd"]
    assert views.part(spark, small, "workspace", "tools").count() > 0
    docs, vectors = table(spark, small, "documents"), table(spark, small, "embeddings")
    assert views.search(docs, text="heatmap sessions", size=5).count() == 5
    assert views.search(docs, vectors, "heatmap", 0, "hybrid").count() > 0
    assert views.search(docs, vectors, query_id=0, mode="semantic", strict=True).count() <= views.search(docs, vectors, query_id=0, mode="semantic", size=1000).count()
    for wrong in ({"text": " "}, {"text": "a", "mode": "odd"}, {"text": "a", "mode": "hybrid"}):
        with pytest.raises(ValueError):
            views.search(docs, **wrong)


def test_line_features(spark):
    got = K.line_features("  aab 12!")
    assert got[0] == pytest.approx(K.entropy("  aab 12!")) and got[1:5] == (2 / 9, 1 / 9, 2 / 9, 2 / 8) and got[5:7] == (3.0, 0.0) and got[8] == 1 / 9
    assert K.line_features(None) == K.line_features("") == (0.0,) * 9 and K.line_features("a")[4] == 0
    df = spark.createDataFrame([("abcdefghi x",), (None,)], "s string")
    assert [r.f.long_word_ratio for r in df.select(K.features_column(df.s).alias("f")).collect()] == [0.5, 0.0]


def test_texts_of_json(spark):
    rows = ['["a", {"text": " b "}, {"value": ["c", null]}, 4, {"x": 1}]', '{"text": "", "content": {"value": "d"}}', '"s"', "null", "{cut", None, '[{"type": "text", "text": "t"}, {"type": "thinking", "thinking": "h"}, {"type": "x", "content": "c"}, " ", "p", 3]', '{"output": "o", "result": "r"}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, j string")
    got = [(r.c, r.f) for r in df.select("i", K.text_column(df.j).alias("c"), K.text_column(df.j, "flattened").alias("f")).orderBy("i").collect()]
    assert got == [("a\nb\nc\n4", "a"), ("d", ""), ("s", "s"), ("", ""), (None, None), (None, None), ("t\nc\np\n3", "t\nh\nc\np"), ("", "o")]
