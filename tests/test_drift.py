import json
from datetime import datetime, timedelta

import pytest

from turnloom.functions import jsontree as J
from turnloom.operators import drift
from turnloom.operators.drift import canonical_names, cast, changes, column_type, content_of, form_of, leaves, records_of, rules, steps, supports, unified, versions

FILES = "file_id long, install_id string, rel_path string, cli_version string, written_at timestamp_ntz, payload string, change string"
LONG = "a text that is long enough to tell a message"


def files(spark, *payloads, install="i"):
    at = datetime(2024, 1, 1)
    return spark.createDataFrame([(n, install, f"f{n}", None, at + timedelta(days=n), json.dumps(p) if isinstance(p, dict) else p, "x") for n, p in enumerate(payloads)], FILES)


def found(df):
    return sorted(tuple(r) for r in changes(df).select("file_id", "change", "old_field", "new_field").collect())


def test_changes(spark):
    df = files(
        spark,
        {"messages": [{"role": "user", "text": LONG, "n": 1, "gone": True}]},
        "{cut off",
        {"messages": [{"speaker": "user", "text": LONG, "n": "1", "fresh": [1]}]},
        {"turns": [{"request": {"speaker": "user", "text": LONG, "n": "1", "fresh": [1]}}]},
        {"turns": []},
        {"conversations": [{"messages": [{"speaker": "user", "content": LONG, "n": "1", "fresh": [1], "none": None}]}]},
    )
    assert found(df) == [
        (2, "added", "", "fresh"), (2, "removed", "gone", ""), (2, "renamed", "role", "speaker"), (2, "retyped", "n", "n"),
        (3, "moved", "messages", "turns"),
        (5, "moved", "turns", "conversations"), (5, "renamed", "text", "content"),
    ]


def test_registry_helps_where_a_file_has_no_overlap(spark):
    with_overlap = files(spark, {"messages": [{"role": "user", "text": LONG}]}, {"messages": [{"role": "user", "body": LONG}]}, install="a")
    without = files(spark, {"messages": [{"role": "user", "text": "one thing that was said here"}]}, {"messages": [{"role": "user", "body": "another thing that was said here"}]}, install="b").selectExpr("file_id + 10 as file_id", "install_id", "rel_path", "cli_version", "written_at", "payload", "change")
    assert (11, "renamed", "text", "body") in found(with_overlap.unionByName(without))
    assert found(without) == [(11, "added", "", "body"), (11, "removed", "text", "")]
    names = dict(canonical_names(with_overlap.unionByName(without)).collect())
    assert names["text"] == names["body"] == "body"


def test_repeats_and_ties(spark):
    same = {"messages": [{"role": "user", "text": LONG}]}
    other = {"messages": [{"role": "user"}]}
    df = files(spark, same, other, same).selectExpr("file_id", "install_id", "case when file_id = 2 then 'f0' else rel_path end as rel_path", "cli_version", "written_at", "payload", "change")
    assert found(df) == [(1, "removed", "text", "")]
    nulls = df.selectExpr("file_id", "cast(null as string) as install_id", "rel_path", "cli_version", "cast(null as timestamp_ntz) as written_at", "payload", "change")
    assert found(nulls) == [(1, "removed", "text", "")]
    assert found(files(spark, same).limit(0)) == []


def cells(df, *columns):
    return {(r.file_id, r.ordinal): tuple(r[c] for c in columns) for r in unified(df).collect()}


def test_unified(spark):
    df = files(spark, {"messages": [{"role": "user", "text": LONG, "n": 1}]}, {"messages": [{"speaker": "user", "text": LONG, "n": None}, {}]})
    assert cells(df, "role", "text", "n", "extra") == {(0, 0): ("user", LONG, 1, {}), (1, 0): ("user", LONG, None, {}), (1, 1): (None, None, None, {})}
    assert unified(df).schema["n"].dataType.simpleString() == "bigint"
    assert unified(df.limit(0)).columns == list(drift._FIXED) and unified(df.limit(0)).count() == 0


def test_fields_of_one_name_in_one_message(spark):
    """What the column can't take goes on in extra; names that differ by case or clash with a column of the table are told apart."""
    df = files(spark, {"messages": [{"text": LONG, "N": 1, "n": "x", "raw": "r", "": True}]}, {"messages": [{"body": LONG, "text": "both", "N": 2}]}, {"messages": [{"body": "both", "N": 2}]})
    names = {r.field: r.name for r in rules(df).collect()}
    got = {(r.file_id, r.ordinal): r.asDict() for r in unified(df).collect()}
    if names["text"] == names["body"]:
        assert got[1, 0]["body"] == LONG and got[1, 0]["extra"] == {"text": "both"}
    assert got[0, 0]["raw_"] == "r" and {got[0, 0][c] for c in got[0, 0] if c.lower() in ("n", "n_")} == {1, "x"} and got[0, 0]["_"] is True
    assert json.loads(got[0, 0]["raw"]) == {"text": LONG, "N": 1, "n": "x", "raw": "r", "": True}


def test_every_value_is_in_one_cell(spark, small):
    """Of real files: each value of each message is in its column or in extra, and nothing else is; a column gives back what was written."""
    table = spark.read.parquet(f"{small}/cli_session_files.parquet")
    rule = {r.field: r for r in rules(table).collect()}
    rows = unified(table)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    got = {(r.file_id, r.ordinal): r.asDict() for r in rows.collect()}
    n = 0
    for f in table.select("file_id", "payload").collect():
        for i, record in enumerate(records_of(f.payload)[1]):
            row = got[f.file_id, i]
            n += 1
            filled = {c: v for c, v in row.items() if c not in drift._FIXED and v is not None}
            for k, v in sorted(record.items()):
                if v is None:
                    continue
                shape, content = content_of(v)
                column = rule[k].name
                if k in row["extra"]:
                    assert row["extra"][k] == content
                    continue
                value = filled.pop(column)
                assert kinds[column] == rule[k].type
                if isinstance(value, list):
                    assert value == ([p.strip() for p in content.split(";")] if shape == "string" and content.strip() else J.parse(content) if shape == "array" else [])
                else:
                    assert (str(value).lower() if isinstance(value, bool) else str(value)) == content
            assert not filled
    assert n == len(got) > 50


def test_forms_and_types():
    forms = [form_of(*content_of(J.parse(t))) for t in ("true", '"false"', "7", '"7"', "-0", "1.5", "1e3", '"07"', '["a"]', '{"a": 1}', "12345678901234567890")]
    assert forms == [1, 1, 2, 2, 8, 4, 8, 8, 16, 32, 8]
    assert [column_type(f) for f in (1, 2, 4, 6, 3, 8, 16, 24, 18, 48, 10)] == ["boolean", "bigint", "double", "double", "string", "string", "array<string>", "array<string>", "array<string>", "string", "string"]
    assert cast("double", "number", "2") == 2.0 and cast("array<string>", "number", "5") == ["5"] and cast("array<string>", "string", " ") == []


def test_chains_of_any_length(spark):
    made = [("a", "b", 5), ("b", "c", 3), ("c", "d", 9), ("d", "e", 2)]
    got = {(r.old_field, r.new_field): r.support for r in supports(spark.createDataFrame(made + [(b, a, n) for a, b, n in made], "old_field string, new_field string, agreeing long")).collect()}
    assert got["a", "b"] == 5 and got["a", "c"] == 3 / 1000 and got["a", "d"] == pytest.approx(3e-6) and got["a", "e"] == pytest.approx(3e-9) and len(got) == 20
    assert supports(spark.createDataFrame([], "old_field string, new_field string, agreeing long")).count() == 0


def test_versions_and_steps(spark):
    a, b = {"messages": [{"role": "user", "text": LONG}]}, {"messages": [{"speaker": "user", "text": LONG}]}
    df = files(spark, a, a, b, "{cut", b, a)
    got = sorted(tuple(r) for r in versions(df).select("install_id", "version", "file_id", "files").collect())
    assert got == [("i", 1, 0, 2), ("i", 2, 2, 2), ("i", 3, 5, 1)]
    ids = {r.version: r.schema_id for r in versions(df).collect()}
    assert ids[1] == ids[3] != ids[2]
    assert sorted(tuple(r) for r in steps(df).collect()) == [("i", 2, 2, "renamed", "role", "speaker"), ("i", 3, 5, "renamed", "speaker", "role")]
    assert versions(df.limit(0)).count() == steps(df.limit(0)).count() == 0


def test_parts():
    assert records_of('{"turns": [{"request": {"a": 1}, "response": 3}, 4]}') == ("turns", [{"a": "1"}])
    assert records_of("[]") == records_of(None) == records_of("5") == (None, [])
    assert leaves({"type": "text", "text": "x"}) == leaves([{"name": "x"}]) == leaves("x") == ["x"]
    assert leaves("a;b") == leaves(["b", "a"])


def test_unified_keeps_what_values_say(spark):
    said = "I ran 280 tests in fusion; 8 of them touch the rolling resolver snapshot."
    df = files(
        spark,
        {"messages": [{"text": said, "files": ["z.py", "a.py", "z.py"], "part": {"type": "tool", "id": 7, "name": "grep"}}, {"text": LONG, "files": ["b;c"]}]},
        {"messages": [{"body": [{"type": "text", "text": LONG}], "files": "z.py;a.py;z.py"}, {"body": {"text": said, "format": "plain"}, "files": ""}, {"body": {"text": said, "format": "html"}}]},
    )
    assert cells(df, "body", "files", "part") == {
        (0, 0): (said, ["z.py", "a.py", "z.py"], '{"type":"tool","id":7,"name":"grep"}'),
        (0, 1): (LONG, ["b;c"], None),
        (1, 0): (LONG, ["z.py", "a.py", "z.py"], None),
        (1, 1): (said, [], None),
        (1, 2): ('{"text":"' + said + '","format":"html"}', None, None),
    }
    few = files(spark, {"messages": [{"tags": "b;a"}, {"tags": "c"}, {"tags": ["b", "a"]}, {"tags": ["x;y", "z"]}, {"tags": []}, {"tags": 7}]})
    assert [r.tags for r in unified(few).orderBy("ordinal").collect()] == [["b", "a"], ["c"], ["b", "a"], ["x;y", "z"], [], ["7"]]


def test_content():
    assert content_of(records_of('{"messages": [{"a": 1.50}]}')[1][0]["a"]) == ("number", "1.50")
    assert content_of(True) == ("boolean", "true") and content_of("b;a") == ("string", "b;a")
    assert content_of([{"type": "text", "text": "x"}]) == content_of({"name": "x"}) == content_of("x") == ("string", "x")
    assert content_of([{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]) == ("object", '[{"type":"text","text":"x"},{"type":"text","text":"y"}]')
    assert content_of(["b", "a", "b"]) == ("array", '["b","a","b"]')
