"""Counting the lines of a source tree, by its ignore rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.text import LANGUAGES

#: Endings that count as documents and not as code.
DOCUMENTS = ("md", "rst", "txt", "adoc")
#: Files larger than this aren't read.
MOST_BYTES = 10_000_000


def ignore_rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """(pattern, negated, folders only) of a line of an ignore file, None for a blank or a comment."""
    s = line.rstrip("\n").rstrip()
    if not s or s.startswith("#"):
        return None
    negated, s = s.startswith("!"), s.removeprefix("!")
    only, s = s.endswith("/"), s.rstrip("/")
    anchored = "/" in s
    s = s.lstrip("/")
    out, i = "", 0
    while i < len(s):
        if s.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif s.startswith("**", i):
            out, i = out + ".*", i + 2
        elif s[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif s[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(s[i]), i + 1
    return re.compile(("^" if anchored else "(?:^|.*/)") + out + "$"), negated, only


def ignored(path: str, rules: list[tuple[re.Pattern, bool, bool]]) -> bool:
    """Whether a file is left out: the last rule that matches it or a folder above it counts."""
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        part, state = "/".join(parts[:n]), False
        for pattern, negated, only in rules:
            if (not only or n < len(parts)) and pattern.match(part):
                state = not negated
        if state:
            return True
    return False


def lines_of_code(spark: SparkSession, root: str, ignore: str = "") -> DataFrame:
    """(kind, ending, files, lines) of a tree: non-blank lines of code and document files that the rules keep."""
    rules = [r for r in map(ignore_rule, ignore.split("\n")) if r]
    base = root.rstrip("/")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for path, content in zip(df["path"], df["content"]):
                relative = path.split(base, 1)[-1].lstrip("/")
                ending = relative.rsplit(".", 1)[-1].lower() if "." in relative else ""
                kind = "document" if ending in DOCUMENTS else "code" if ending in LANGUAGES else None
                if kind and not ignored(relative, rules):
                    rows.append((kind, ending, sum(1 for x in content.decode("utf-8", "ignore").split("\n") if x.strip())))
            yield pd.DataFrame(rows, columns=["kind", "ending", "lines"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= MOST_BYTES).select("path", "content")
    return files.mapInPandas(count, "kind string, ending string, lines long").groupBy("kind", "ending").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"))
