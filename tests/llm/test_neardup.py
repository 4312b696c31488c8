import random
import re
from itertools import combinations

import pytest

from turnloom.llm import expand, neardup
from turnloom.llm.neardup import ENTRIES, _hot_candidates, components, groups, similar_pairs

TEXTS = "id long, text string, shingles string, rep int"


def sets(rows, size, least):
    out = {}
    for i, t in rows:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        if len(w) >= max(least, size):
            out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    return out


def brute(rows, size, least, threshold):
    s = sets(rows, size, least)
    return {(a, b) for a, b in combinations(sorted(s), 2) if len(s[a] & s[b]) / len(s[a] | s[b]) >= threshold}


def corpus(n, words, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    rows, base = [], []
    for i in range(n):
        if base and r.random() < 0.6:
            t = list(r.choice(base))
            for _ in range(r.randint(0, 6)):
                at = r.randrange(len(t))
                t[at : at + r.randint(0, 1)] = [r.choice(vocabulary)] * r.randint(0, 2) or [r.choice(vocabulary)]
        else:
            t = [r.choice(vocabulary) for _ in range(r.randint(8, 60))]
        base.append(t)
        rows.append((i * 3, " ".join(t).upper() if i % 7 == 0 else ", ".join(t)))
    return [*rows, (1, None), (4, ""), (7, "one two"), (10, "ä ö ü " * 50)]


@pytest.mark.parametrize("size,least,threshold,hot,words", [(3, 10, 0.7, 4096, 500), (3, 10, 0.7, 3, 12), (5, 5, 0.8, 2, 500), (2, 2, 0.5, 5, 6)])
def test_against_all_pairs(spark, size, least, threshold, hot, words):
    rows = corpus(160, words, size * 10 + hot)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TEXTS)
    want = brute(rows, size, least, threshold)
    got = [tuple(r) for r in similar_pairs(df, size=size, least_words=least, threshold=threshold, hot=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 20
    table = {r.id: r for r in groups(df, size=size, least_words=least, threshold=threshold, hot=hot).collect()}
    assert set(table) == set(sets(rows, size, least))
    for i, r in table.items():
        assert r.links == sum(i in p for p in want)
    for a, b in want:
        assert table[a].group_id == table[b].group_id <= a


def test_long_texts(spark):
    r = random.Random(2)
    t = [f"v{r.randrange(10**6)}" for _ in range(9000)]
    rows = [(1, " ".join(t)), (2, " ".join(t[:8000])), (3, " ".join(t[:5000])), (4, " ".join(t))]
    df = spark.createDataFrame([(*x, "x", 1) for x in rows], TEXTS)
    assert sorted(tuple(x) for x in similar_pairs(df).collect()) == [(1, 2), (1, 4), (2, 4)]


def test_empty(spark):
    df = spark.createDataFrame([], TEXTS)
    assert similar_pairs(df).count() == groups(df).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (7, 100)] + [(200, 201)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {v for k, v in got.items() if k < 150} == {0} and got[201] == got[200] == 200


def test_tiles_of_very_long_texts_meet(spark):
    """Points that overflowed bound nothing: two equal sets of 100,000 shingles are a candidate of a hot cell."""
    rows = spark.createDataFrame([(7, i, 100_000, 0, 0, 0, -1, True) for i in (1, 2)] + [(7, 3, 50, 0, 0, 0, 0, True)], ENTRIES)
    cells = spark.createDataFrame([(7, 3)], "token long, texts long")
    assert [tuple(r) for r in _hot_candidates(rows, cells, 0.7, 1).collect()] == [(1, 2)]


def test_copies_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(expand, "COPIES", 4)
    a, b = (" ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(1, 41)))
    rows = [(i, a if i % 2 else b) for i in range(30)] + [(90, "alone " + a[:60])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TEXTS)
    got = [tuple(r) for r in similar_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 5, 5, 0.8) and len(got) == 30 * 29 // 2


def test_frequencies_are_levels_of_counts(spark):
    rows = spark.createDataFrame([(i, [1, 2 + i % 3, 1 << 40]) for i in range(50)], "id long, shingles array<long>").repartition(5)
    table = neardup.frequencies(rows, 150)
    assert len(table) == neardup.LEAST_GROUPS and table[0] == table[1] == neardup.level(50) and table[2] == neardup.level(17) and table[5:].max() == 0
    assert len(neardup.frequencies(rows.limit(0), 0)) == neardup.LEAST_GROUPS
    scale = neardup.level(range(100_000))
    assert (scale[1:] >= scale[:-1]).all() and scale[0] == 0 < scale[1] and neardup.level(1 << 40) == 255
    for counts in ([0, 255], [256], [70_000], [1 << 40]):
        assert neardup._unpacked(neardup._packed(neardup.np.array(counts))).tolist() == counts


def test_no_broadcast_of_texts_or_ids(spark):
    """What grows with the data is joined by shuffles; only the table of bits is broadcast."""
    df = spark.createDataFrame([(i, "x" * i, "x", 1) for i in range(5)], TEXTS)
    plan = similar_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
