import random

import numpy as np
import pytest

from turnloom.operators.search import Unit, alike, bm25, fuse, nearest, parsed, ranked, ranked_all, subsets
from turnloom.plans import views


@pytest.mark.parametrize("query,wanted", [
    ("one", {1, 2, 5}), ("One two", {1, 2}), ("one OR four", {1, 2, 4, 5}), ("one NOT two", {5}), ('"two one"', {2}), ("fo*", {4}), ("(one OR four) five", {4}), ("one AND (two OR six)", {1, 2, 5}), ("one OR two NOT two", {1, 2, 5}),
    ("two (one", {2}), ('one"', {1, 2, 5}), ("NOT", set()), ("***", set()), ("", set()), ("AND two", set()), ("zz", set()),
])
def test_query_language(spark, query, wanted):
    docs = spark.createDataFrame([(1, "one two"), (2, "Two, one!"), (3, None), (4, "four five"), (5, "one six"), (6, "")], "doc_id int, text string")
    assert {r.doc_id for r in bm25(docs, query).collect()} == wanted


def test_parsed():
    assert parsed("a b OR c") == (("or", ("and", Unit(("a",)), Unit(("b",))), Unit(("c",))), [Unit(("a",)), Unit(("b",)), Unit(("c",))])
    assert parsed("a NOT b")[1] == [Unit(("a",))]
    assert parsed("a AND") == (Unit(("a", "and")), [Unit(("a", "and"))])


def test_more_of_a_term_is_better(spark):
    docs = spark.createDataFrame([(1, "cat dog bird"), (2, "cat cat bird"), (3, "fish bird cow"), (4, "ant bee owl")], "doc_id int, text string")
    scores = dict(bm25(docs, "cat").collect())
    assert scores[2] > scores[1]


def test_nearest_against_all_products(spark):
    r = np.random.default_rng(1)
    v = r.integers(-2, 3, (150, 6)).astype(float)
    rows = [(i, v[i].tolist()) for i in range(150)] + [(900, None), (901, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest(df, df.where("vec_id % 20 = 0"), 5)
    by = {}
    for x in got.collect():
        by.setdefault(x.query_id, []).append((x.rank, x.vec_id))
    for q in range(0, 150, 20):
        order = sorted((i for i in range(150) if i != q), key=lambda i: (-float(v[q] @ v[i]), i))[:5]
        assert [i for _, i in sorted(by[q])] == order
    assert nearest(df.limit(0), df, 3).count() == nearest(df, df.limit(0), 3).count() == 0


def test_few_and_many_queries_give_the_same(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(i, r.integers(-1, 2, 4).astype(float).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    few = lambda: sorted(tuple(x) for x in nearest(df, df.where("vec_id % 9 = 0"), 4).collect())
    some = lambda: sorted(tuple(x) for x in alike(df, df.where("vec_id % 9 = 0"), 2.0).collect())
    first, second = few(), some()
    monkeypatch.setattr("turnloom.operators.search.QUERIES", 7)
    monkeypatch.setattr("turnloom.operators.search.ROWS", 50)
    assert few() == first and some() == second and len(first) == 34 * 4


def test_words_of_any_script(spark):
    from turnloom.functions import text as X

    texts = ["Über die STRASSE", "naïve café\u0301", "Ελληνικά ρήμα 日本語 x²", "ёлка\tЙод", "", "İstanbul", "a-b_c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.w for r in df.select(X.words(df.t).alias("w")).collect()]
    assert got == [list(X.words_of(t)) for t in texts] and got[0] == ["uber", "die", "strasse"] and got[1] == ["naive", "cafe"] and got[6] == ["a", "b", "c"]


def test_fuse(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id int, rank int")
    got = dict(fuse(a, b, "id").collect())
    assert got[2] == 1.0 and got[1] == pytest.approx((1 / 61) / (1 / 62 + 1 / 61)) and got[3] < got[1]


def test_subsets(spark):
    r = random.Random(4)
    sets = {f"k{i}": frozenset(r.sample("abcdefg", r.randint(1, 4))) for i in range(40)}
    df = spark.createDataFrame([(k, x) for k, s in sets.items() for x in s] + [("k0", None)], "k string, i string")
    rep = {k: min(o for o, y in sets.items() if y == x) for k, x in sets.items()}
    want = {(k, r) for k, r in rep.items() if k != r} | {(a, b) for a in set(rep.values()) for b in set(rep.values()) if sets[a] < sets[b]}
    got = [tuple(x) for x in subsets(df, "k", "i").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert subsets(df.limit(0), "k", "i").count() == 0


def test_ranked_all(spark):
    df = spark.range(500).repartition(7).selectExpr("id", "cast(id * 37 % 50 as double) as score")
    want = sorted((tuple(r) for r in ranked(df, "id", 500).select("id", "rank").collect()))
    assert sorted(tuple(r) for r in ranked_all(df, "id").select("id", "rank").collect()) == want
    assert ranked_all(df.limit(0), "id").count() == 0


def test_hybrid_fuses_whole_lists(spark):
    n = 240
    docs = spark.createDataFrame([(i, "heatmap " + "word " * i) for i in range(1, n + 1)], "doc_id long, text string")
    # the nearest vector is that of the document with the last keyword rank
    vectors = spark.createDataFrame([(0, [1.0, 0.0])] + [(i, [0.2 if i < 20 else 0.3 + i / 1000, 0.0]) for i in range(1, n + 100)], "vec_id long, embedding array<double>")
    assert alike(vectors, vectors.where("vec_id = 0"), 0.3).count() == n + 80
    keyword = {i: i for i in range(1, n + 1)}
    near = {i: r for r, i in enumerate(range(n + 99, 19, -1), 1)}
    raw = {i: (1 / (60 + keyword[i]) if i in keyword else 0) + (1 / (60 + near[i]) if i in near else 0) for i in keyword | near}
    order = sorted(raw, key=lambda i: (-raw[i] / max(raw.values()), i))
    got = views.search(docs, vectors, "heatmap", 0, "hybrid", number=1, size=20).collect()
    assert [r.doc_id for r in got] == order[:20]
    assert [r.score for r in got] == pytest.approx([raw[i] / max(raw.values()) for i in order[:20]])
    assert views.search(docs, vectors, "heatmap", 0, "hybrid", number=4, size=100).count() == len(raw) - 300
    assert views.search_total(docs, vectors, "heatmap", 0, "hybrid") == len(raw) == n + 99
    assert views.search_total(docs, vectors, query_id=0, mode="semantic") == n + 80
