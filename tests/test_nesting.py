import json
import random

from turnloom.functions.jsontree import parse
from turnloom.operators.nesting import objects, objects_of, occurrences


def brute(text):
    """(node, parent) of objects in arrays, by plain recursion."""
    out = []

    def walk(v, at, parent, in_array):
        if isinstance(v, str):
            try:
                inner = json.loads(v)
            except ValueError:
                return
            if not isinstance(inner, (dict, list)):
                return
            v = inner
        if isinstance(v, dict):
            if in_array:
                out.append((at, parent))
                parent = at
            for k, x in v.items():
                walk(x, f"{at}/{k.replace('~', '~0').replace('/', '~1')}", parent, False)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{at}/{i}", parent, True)

    try:
        walk(json.loads(text), "", "", False)
    except ValueError:
        pass
    return sorted(out)


def tree(r, depth):
    kind = r.random()
    if depth == 0 or kind < 0.25:
        return r.choice([None, True, 1, 2.5, "a", "", "é", "[oops", '{"k": [{"z": 1}]}'])
    value = [tree(r, depth - 1) for _ in range(r.randint(0, 3))] if kind < 0.6 else {r.choice(["a", "b/c", "d~e", "", "f"]): tree(r, depth - 1) for _ in range(r.randint(0, 3))}
    return json.dumps(value) if kind > 0.93 else value


def cases(text):
    return sorted((o[0], o[1]) for o in objects_of(text) if o[4])


def test_against_recursion():
    r = random.Random(5)
    for _ in range(1500):
        text = json.dumps(tree(r, 5))
        text = text[: r.randint(0, len(text))] if r.random() < 0.1 else text
        assert cases(text) == brute(text)


def test_ids_are_of_content():
    a, b = objects_of('{"x": [{"p": 1, "q": [2]}, {"q": [2], "p": 1}]}')[1:]
    assert a[5] == b[5] and [a[3], b[3]] == [0, 1]
    assert objects_of('{"p": 1}')[0][5] != objects_of('{"p": "1"}')[0][5] != objects_of('{"p": 1.0}')[0][5]
    assert objects_of('{"p": {"a": 1}}')[0][5] != objects_of('{"p": "{\\"a\\": 1}"}')[0][5]


def test_odd_texts():
    for text in (None, "", "  ", "[NaN, {}]", "[Infinity, {}]", '[{"a": 1}', "[{}]x", "{'a': 1}", "[01]"):
        assert objects_of(text) == []
    assert cases(' [{}] ') == [("/0", "")] and cases('"[{}]"') == [("/0", "")]
    assert cases("[" * 20_000 + "{}" + "]" * 20_000) == [("/0" * 20_000, "")]
    assert cases('[{"a": ' + "9" * 10_000 + "}]") == [("/0", "")]
    assert cases('[{"a": "\\ud800"}]') == [("/0", "")]
    assert parse('{"a": 1, "a": 2}') == {"a": "2"}


def test_tables(spark):
    rows = [("t", 1, '[{"a": 1}, {"a": 1}]', 9), ("t", 1, '[{"a": 1}, {"a": 1}]', 9), ("t", 2, None, 9), (None, None, "[{}]", 9)]
    bridge = occurrences(spark.createDataFrame(rows, "src string, row_id long, text string, node long"))
    assert bridge.count() == 5
    found = {r.body: r.occurrences for r in objects(bridge).collect()}
    assert found == {'{"a":1}': 4, "{}": 1}
    assert occurrences(spark.createDataFrame([], "src string, row_id long, text string")).count() == 0


def test_objects_and_bridge_of_real_tables_fit(spark, small):
    """Every object is stored once, its occurrences add up to the bridge, and every reference and parent leads to a stored object."""
    import re

    from turnloom.plans.problems import p4_bridge, p4_found, p4_objects

    bridge = p4_bridge(spark, small).collect()
    stored = {r.object_id: r for r in p4_objects(spark, small).collect()}
    assert {r.object_id for r in bridge} == set(stored) and sum(r.occurrences for r in stored.values()) == len(bridge) > 100
    assert all(x in stored for r in stored.values() for x in re.findall(r'\{"\$object":"([0-9a-f]{32})"\}', r.body))
    at = {(r.src, r.row_id, r.node): r for r in bridge}
    assert len(at) == len(bridge)
    for r in bridge:
        if r.holder is not None:
            assert at[r.src, r.row_id, r.holder].object_id == r.holder_id and r.node.startswith(r.holder)
        if r.parent:
            assert at[r.src, r.row_id, r.parent].in_array
    assert p4_found(spark, small).count() == sum(r.in_array for r in bridge)
