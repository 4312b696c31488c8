"""Encoding with a public byte-level tokenizer: tiktoken over a local rank file."""

from __future__ import annotations

import base64
import importlib.util
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters from which a text is cut into pieces before it is encoded.
LONG = 50_000
#: Fixed value: how the public byte-level tokenizers split text before they merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A place where two pre-tokens always meet: white space after an ASCII letter, digit or mark. No pre-token
#: of the public pattern goes on over it, and its look-ahead concerns runs of white space only.
_SAFE = re.compile(r"(?<=[!-~])(?=[ \n])")


def default_ranks() -> str:
    """The path of the public rank file byte_bpe_50k.tiktoken of this machine."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec else os.environ.get("TURNLOOM_TOKENIZERS", "/opt/tokenizers")
    return os.path.join(folder, "byte_bpe_50k.tiktoken")


def ranks(path: str | None) -> dict[bytes, int]:
    """The tokens of a rank file, with their ids."""
    with open(path or default_ranks(), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def encoding(path: str | None, pattern: str | None = None):
    """The tiktoken encoding of a rank file, loaded once a worker. It knows no special tokens."""
    import tiktoken

    return tiktoken.Encoding("local", pat_str=pattern or PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def pieces(text: str, long: int = LONG) -> list[str]:
    """text cut at safe places, each piece long characters or a little more; whole where there is no such place."""
    out, at = [], 0
    while len(text) - at > long:
        if (m := _SAFE.search(text, at + long)) is None:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def encode(text: str | None, path: str | None = None) -> list[int]:
    """The ids of a text, an empty list for NULL and ''. Strings that look like special tokens are ordinary text."""
    if not text:
        return []
    e = encoding(path)
    return e.encode_ordinary(text) if len(text) <= LONG else [i for p in pieces(text) for i in e.encode_ordinary(p)]


def decode(ids: list[int], path: str | None = None) -> bytes:
    """The bytes of ids. Single ids may be parts of a character, so bytes are joined before they are read as text."""
    return encoding(path).decode_bytes(list(ids))


def ids_of(text: Column, path: str | None = None) -> Column:
    """The ids of a text column: a map in Arrow batches, without a shuffle."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([encode(t, path) for t in s], dtype=object)

    return ids(text)


def count_of(text: Column, path: str | None = None) -> Column:
    """The number of ids of a text column, 0 for NULL and ''."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([len(encode(t, path)) for t in s], dtype="int32")

    return count(text)


def text_of(ids: Column, path: str | None = None) -> Column:
    """The text of a column of ids, by way of its bytes."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if i is None else decode(i, path).decode("utf-8", "replace") for i in s], dtype=object)

    return text(ids)


def encoded(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every document. Repeated rows are kept; other columns don't reach Python."""
    return documents.select("doc_id", ids_of(F.col("text"), path).alias("ids"))
