"""Vectors: bytes and back, products, and an encoder without a model."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The product of two vectors in double precision; NULL where their lengths differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product)


def to_bytes(vector: list[float]) -> bytes:
    """A vector as 32-bit floats, little end first."""
    return np.asarray(vector, dtype="<f4").tobytes()


def from_bytes(data: bytes) -> list[float]:
    return np.frombuffer(data, dtype="<f4").tolist()


def hashed(text: str | None, size: int = 64) -> list[float]:
    """A unit vector of signed counts of hashed words: texts that share words are near. A zero vector for no words."""
    v = np.zeros(size)
    for word in re.findall(r"\w+", (text or "").lower()):
        h = int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "big")
        v[h % size] += 1.0 if h >> 63 else -1.0
    norm = float(np.linalg.norm(v))
    return (v / norm if norm else v).astype("float32").tolist()


def encoded(text: Column, size: int = 64) -> Column:
    """The hashed vector of a text column, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([hashed(t, size) for t in s], dtype=object)

    return run(text)
