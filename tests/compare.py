"""Comparing the rows of two engines, without regard to order."""

import decimal
import math
from collections import Counter


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(df):
    columns = sorted(df.columns)
    return columns, Counter(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())


def duck_rows(connection, sql):
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())
