from turnloom.llm.conversations import conversations, dropped, resolve

TURNS = "id long, session_id string, turn int, role string, original_text string, end string"


def table(spark, **sessions):
    rows, n = [], 0
    for s, messages in sessions.items():
        for m in messages:
            n += 1
            rows.append((n, None if s == "none" else s, *m, "x"))
    return spark.createDataFrame(rows, TURNS)


def test_reasons(spark):
    u, a = (0, "user", "q"), (1, "assistant", "w")
    df = table(
        spark, good=[u, a], human=[(0, " Human", "q"), (1, "BOT", "w")], again=[u, a, u, a], late=[a, u], system=[(0, "system", "s"), (1, "user", "q"), (2, "system", "s"), (3, "model", "w")], long=[(i, ("user", "bot")[i % 2], "t") for i in range(300)],
        empty=[(0, "user", " ​ "), (1, "assistant", None)], hole=[u, (2, "assistant", "w")], conflict=[u, a, (1, "assistant", "other")], start=[(1, "user", "q"), (2, "assistant", "w")], negative=[(-1, "user", "q"), u, a], noturn=[u, a, (None, "user", "q")], norole=[u, (1, None, "w")], blankrole=[u, (1, " ", "w")], nouser=[(0, "assistant", "w")],
        silent=[u], blank=[u, (1, "assistant", "​")], twice=[u, (1, "user", "q2"), (2, "assistant", "w")], none=[u], emptyrole=[(0, None, None)],
    )
    want = {"empty": "empty", "emptyrole": "empty", **dict.fromkeys(["hole", "conflict", "start", "negative", "noturn", "norole", "blankrole", "nouser"], "broken"), **dict.fromkeys(["silent", "blank", "twice"], "no_reply")}
    assert dict(dropped(df).collect()) == want
    whole = conversations(df)
    assert {r.session_id for r in whole.select("session_id").distinct().collect()} == {"good", "human", "again", "late", "system", "long"}
    assert [(r.position, r.speaker, r.text) for r in whole.where("session_id = 'late'").orderBy("position").collect()] == [(0, "user", "q"), (1, "assistant", "w")]
    assert whole.where("session_id = 'long'").count() == 300 and whole.where("session_id = 'again'").count() == 2
    assert dropped(df.limit(0)).count() == conversations(df.limit(0)).count() == 0


def test_pointer_jumping(spark):
    nodes = [("r", None)] + [(f"n{i}", f"n{i - 1}" if i else "r") for i in range(37)] + [("o1", "gone"), ("o2", "o1"), ("c1", "c2"), ("c2", "c1"), ("c3", "c1"), ("self", "self")]
    got = {r.node: (r.end, r.depth, r.state) for r in resolve(spark.createDataFrame(nodes, "node string, parent string")).collect()}
    assert got["n36"] == ("r", 37, "root") and got["r"] == ("r", 0, "root")
    assert got["o2"] == ("o1", 1, "orphan") and got["o1"] == ("o1", 0, "orphan")
    assert all(got[k] == (None, None, "cycle") for k in ("c1", "c2", "c3", "self"))
