import pytest

from turnloom.operators import keys
from turnloom.operators.keys import having, lacking


@pytest.mark.parametrize("bits", [1 << 26, 1 << 15])
def test_against_sets(spark, monkeypatch, bits):
    """Whatever the size of the table: keys, rows without one, NULL keys, repeated keys and rows, another column of the keys' table."""
    monkeypatch.setattr(keys, "BITS", bits)
    rows = spark.createDataFrame([(i, f"r{i}", 1) for i in range(2000)] + [(5, "again", 2), (None, "none", 3)], "k long, text string, n int")
    some = spark.createDataFrame([(i, "y") for i in range(0, 6000, 3)] + [(5, "z"), (5, "z"), (None, "w")], "k long, text string")
    held = {i for i in range(0, 6000, 3)} | {5}
    got = having(rows, some, "k").collect()
    assert sorted(r.text for r in got) == sorted([f"r{i}" for i in range(2000) if i in held] + ["again"])
    rest = lacking(rows, some, "k").collect()
    assert sorted(r.text for r in rest) == sorted([f"r{i}" for i in range(2000) if i not in held] + ["none"])


def test_texts_as_keys_and_empty_tables(spark):
    rows = spark.createDataFrame([("a",), ("",), (None,)], "k string")
    none = rows.limit(0)
    assert having(rows, none, "k").count() == 0 and lacking(rows, none, "k").count() == 3
    assert having(none, rows, "k").count() == lacking(none, rows, "k").count() == 0
    assert [r.k for r in having(rows, rows.where("k = ''"), "k").collect()] == [""]
