import random

from pyspark.sql import functions as F

from turnloom.operators import neighbours as N


def test_over_buckets_as_over_keys(spark):
    r = random.Random(3)
    data = [(k, t, r.randint(0, 9)) for k in ("a", None, "c") for t in sorted(r.sample(range(100), 40))]
    df = spark.createDataFrame(data, "k string, t int, v int")
    bucket = F.floor(F.col("t") / 7)
    rows = N.running(N.next_row(N.previous_row(df, "k", bucket, ["t"], F.struct("t")), "k", bucket, ["t"], F.struct("t")), "k", bucket, ["t"], sums={"s": F.col("v")}, maxes={"m": F.col("v")}).collect()
    by = {}
    for k, t, v in data:
        by.setdefault(k, []).append((t, v))
    assert len(rows) == len(data)
    for row in rows:
        own = by[row.k]
        i = [t for t, _ in own].index(row.t)
        assert (row.previous.t if row.previous else None) == (own[i - 1][0] if i else None)
        assert (row.next.t if row.next else None) == (own[i + 1][0] if i + 1 < len(own) else None)
        assert row.s == sum(v for _, v in own[:i])
        assert row.m == (max(v for _, v in own[:i]) if i else None)
