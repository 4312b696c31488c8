import pytest
from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.functions import vectors as V
from turnloom.operators import filters as P
from turnloom.operators import index as N


def test_index_follows_changes(spark):
    old = spark.createDataFrame([(1, "one two two"), (2, "three"), (3, " "), (4, None)], "doc_id int, text string")
    new = spark.createDataFrame([(1, "one two two"), (2, "four four"), (3, " "), (4, None), (5, "five")], "doc_id int, text string")
    stored = old.select("doc_id", X.digest(F.col("text")).alias("text_hash"))
    changed = N.stale(new, stored)
    assert sorted(r.doc_id for r in changed.collect()) == [2, 5]
    assert sorted(map(tuple, N.refreshed(N.postings(old), changed).collect())) == sorted(map(tuple, N.postings(new).collect()))
    made = {r.doc_id: r.embedding for r in N.backfilled(new, stored, size=16).collect()}
    assert set(made) == {2, 5} and sum(x * x for x in made[2]) == pytest.approx(1)


def test_vectors(spark):
    assert V.from_bytes(V.to_bytes([1.5, -2.0])) == [1.5, -2.0]
    assert V.hashed(None) == [0.0] * 64 and V.hashed("a b") == V.hashed("B, a!")
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(V.dot(df.a, df.b)).collect()] == [11.0, None]


def test_names_and_paths(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.path(F.lit("/C:\\a\\b"))) == "c:/a/b"
    assert one(X.uri_path(F.lit("file:///c%3A/My%20Code+x"))) == "c:/My Code+x"
    assert tuple(one(X.remote_parts(F.lit("vscode-remote://ssh-remote%2Bhost/home/x")))) == ("ssh-remote", "host", "/home/x")
    assert one(X.remote_parts(F.lit("file:///x"))) is None
    assert one(X.identity(F.lit("C:\\A\\"), F.lit("i"))) == "folder:c:/a" and one(X.identity(F.lit(None).cast("string"), F.lit("i"))) == "id:i"
    assert one(X.folder_id(F.lit("/a.b/c:d"))) == "-a-b-c-d" and one(X.snippet(F.lit("a\nb" * 80), 5)) == "a ba ..."
    for p, wide in (("/", True), ("C:\\", True), ("/home/x", True), ("/home/x/code", False), ("/srv/x", False), ("C:/Users/me", True), (None, False)):
        assert one(P.home_or_root(F.lit(p).cast("string"))) is wide
    assert one(P.inside(F.lit("/a/b"), F.lit("/a/"))) and not one(P.inside(F.lit("/ab"), F.lit("/a")))
    assert one(P.bootstrap_only(F.lit(1), F.lit(None).cast("string"), F.lit("Caveat: x"))) and not one(P.bootstrap_only(F.lit(2), F.lit(None).cast("string"), F.lit("/clear")))
