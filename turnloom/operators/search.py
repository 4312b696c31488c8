"""Keyword, semantic and hybrid search, exact, over whole tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.text import words as words_in
from turnloom.functions.text import words_of
from turnloom.session import cut_lineage

K1, B = 1.2, 0.75
#: Query vectors in a block and rows in a chunk, at most about.
QUERIES, ROWS = 512, 4096


@dataclass(frozen=True)
class Unit:
    """What a query looks for: a word, the beginning of words (prefix) or words in a row (phrase)."""

    words: tuple[str, ...]
    prefix: bool = False

    def count(self, words: Column) -> Column:
        """How often it occurs in an array of words."""
        if len(self.words) == 1:
            word = self.words[0]
            return F.size(F.filter(words, lambda w: w.startswith(word) if self.prefix else w == word))
        return F.regexp_count(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit("(?<= )" + " ".join(self.words) + "(?= )"))


def parsed(text: str) -> tuple[object, list[Unit]]:
    """(expression, units looked for) of a query: words in a row are ANDed, AND, OR, NOT, parentheses, "phrases" and prefix*.

    NOT binds closest, then AND, then OR. An expression is a Unit or ("and" | "or" | "not", left, right). A query that
    can't be read so is taken as one phrase; without any word it is None.
    """
    tokens = re.findall(r'"[^"]*"|[()]|[^\s()"]+|"', text)
    at = 0
    found: list[Unit] = []

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def primary(sought: bool) -> object:
        nonlocal at
        t = peek()
        if t is None or t in ("AND", "OR", "NOT", ")", '"'):
            raise ValueError("a term is missing")
        at += 1
        if t == "(":
            inside = either(sought)
            if peek() != ")":
                raise ValueError("a parenthesis is open")
            at += 1
            return inside
        unit = Unit(words_of(t), t.endswith("*") and not t.startswith('"'))
        if not unit.words or unit.prefix and len(unit.words) > 1:
            raise ValueError("not a term")
        if sought:
            found.append(unit)
        return unit

    def less(sought: bool) -> object:
        nonlocal at
        left = primary(sought)
        while peek() == "NOT":
            at += 1
            left = ("not", left, primary(False))
        return left

    def both(sought: bool) -> object:
        nonlocal at
        left = less(sought)
        while (t := peek()) is not None and t not in ("OR", ")"):
            if t == "AND":
                at += 1
            left = ("and", left, less(sought))
        return left

    def either(sought: bool) -> object:
        nonlocal at
        left = both(sought)
        while peek() == "OR":
            at += 1
            left = ("or", left, both(sought))
        return left

    try:
        tree = either(True)
        if at < len(tokens):
            raise ValueError("more after the end")
        return tree, list(dict.fromkeys(found))
    except ValueError:
        words = words_of(text)
        return (Unit(words), [Unit(words)]) if words else (None, [])


def _holds(tree: object, words: Column) -> Column:
    if isinstance(tree, Unit):
        return tree.count(words) > 0
    kind, left, right = tree
    a, b = _holds(left, words), _holds(right, words)
    return a & b if kind == "and" else a | b if kind == "or" else a & ~b


def bm25(documents: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of the documents that a query holds for, scored by BM25 over what it looks for (higher is better).

    Queries and texts are compared as words of any script without case and accents (functions.text.words); see
    parsed for the query's language. The texts are read once, for a row of counts per document; document numbers and
    lengths come from these, and only documents that match go on. NULL texts take no part; a query without words gives no rows.
    """
    tree, units = parsed(query)
    docs = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("key_"), words_in(F.col(text)).alias("words"))
    words = F.col("words")
    holds = _holds(tree, words) if tree is not None else F.lit(False)
    counted = cut_lineage(docs.select("key_", F.size("words").alias("dl"), holds.alias("holds"), *[u.count(words).alias(f"tf{i}") for i, u in enumerate(units)]))
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(units))])
    joined = counted.where("holds").join(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(units)):
        idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)))
        score = score + idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return joined.select(F.col("key_").alias(key), score.alias("score"))


_SCORES = "query_id bigint, id bigint, score double"


def _best(q: pd.DataFrame, r: pd.DataFrame, k: int | None, least: float | None) -> pd.DataFrame:
    """The products of query vectors (query_id, q) and rows (id, v): of each query the k best with all ties, or all from least on if k is None."""
    empty = pd.DataFrame({"query_id": [], "id": [], "score": []})
    out = []
    for n, some_q in q.groupby(q["q"].map(len)) if len(q) and len(r) else ():
        same = r[r["v"].map(len) == n]
        if same.empty:
            continue
        scores = np.stack(some_q["q"].to_list()).astype("float64") @ np.stack(same["v"].to_list()).astype("float64").T
        ids = same["id"].to_numpy()
        for query, s in zip(some_q["query_id"], scores):
            s = np.where(ids == query, -np.inf, s)
            # the k best with every tie of the last, so that ties are broken by id at the end and not here
            floor = np.partition(s, -k)[-k] if k is not None and len(s) > k else -np.inf
            best = np.flatnonzero((s >= (floor if least is None else max(floor, least))) & np.isfinite(s))
            out.append(pd.DataFrame({"query_id": query, "id": ids[best], "score": s[best]}))
    return pd.concat(out) if out else empty


def _scanned(rows: DataFrame, queries: pd.DataFrame, k: int | None, least: float | None) -> DataFrame:
    """_products of at most QUERIES query vectors, which travel with the tasks: the rows are read where they are and only the best of each task go on."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for r in batches:
            found = _best(queries, r, k, least)
            if k is None:
                yield found
                continue
            held = found if held is None else pd.concat([held, found], ignore_index=True)
            # every tie of the k-th stays, as in _best
            held = held[held.groupby("query_id")["score"].rank(method="min", ascending=False) <= k]
        if held is not None:
            yield held

    return rows.mapInPandas(scan, _SCORES)


def _products(vectors: DataFrame, queries: DataFrame, k: int | None, key: str, vector: str, least: float | None) -> DataFrame:
    """(query_id, id, score) of query vectors and other rows: of each chunk of rows the k best with all ties, or all from least on if k is None."""
    some = queries.where(f"{vector} is not null").select(F.col(key).alias("query_id"), F.col(vector).alias("q"))
    rows = vectors.where(f"{vector} is not null").select(F.col(key).alias("id"), F.col(vector).alias("v"))
    few = some.limit(QUERIES + 1).toPandas()
    if len(few) <= QUERIES:
        return _scanned(rows, few, k, least)
    blocks = max(1, -(-some.count() // QUERIES))
    chunks = max(1, -(-rows.count() // ROWS))
    spread = lambda df, by, own, n_own, other, n_other: df.withColumn(own, F.pmod(F.xxhash64(by), F.lit(n_own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
    left = spread(some, "query_id", "block", blocks, "chunk", chunks)
    right = spread(rows, "id", "chunk", chunks, "block", blocks)

    def product(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        return _best(q, r, k, least)

    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(product, _SCORES)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", least: float | None = None) -> DataFrame:
    """(query_id, key, score, rank): for each query vector the k rows of the largest dot product, the query itself left out.

    Exact: up to QUERIES queries travel to the rows; more meet them in blocks and chunks, one matrix product each, in a
    task of bounded size. Each keeps its k best, so that what is ranked at last is k rows per query and task or chunk.
    Rows of another length or NULL are left out.
    """
    part = _products(vectors, queries, k, key, vector, least)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("id").alias(key), "score", "rank")


def alike(vectors: DataFrame, queries: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, score): for each query vector all rows with a dot product of at least least, the query itself left out; as nearest, without ranks."""
    return _products(vectors, queries, None, key, vector, least).select("query_id", F.col("id").alias(key), "score")


def fuse(first: DataFrame, second: DataFrame, key: str, k: int = 60) -> DataFrame:
    """(key, score) by reciprocal rank fusion of two ranked lists (key, rank): sums of 1 / (k + rank), the best scaled to 1."""
    a = first.select(F.col(key).alias("a_"), F.col("rank").alias("ra"))
    b = second.select(F.col(key).alias("b_"), F.col("rank").alias("rb"))
    part = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    both = a.join(b, F.col("a_") == F.col("b_"), "full").select(F.coalesce("a_", "b_").alias(key), (part("ra") + part("rb")).alias("raw"))
    most = both.agg(F.max("raw").alias("most"))
    return both.join(F.broadcast(most)).select(key, (F.col("raw") / F.col("most")).alias("score"))


def ranked(scores: DataFrame, key: str, k: int) -> DataFrame:
    """(key, score, rank) of the k best: a report of k rows, ordered before it is numbered."""
    best = scores.withColumn("s_", F.round("score", 9)).orderBy(F.col("s_").desc(), key).limit(k)
    return cut_lineage(best).withColumn("rank", F.row_number().over(Window.orderBy(F.col("s_").desc(), key))).drop("s_")


def ranked_all(scores: DataFrame, key: str) -> DataFrame:
    """(key, score, rank) of all rows, in the order of ranked, without one task for all: ranks within ranges of the order, after the rows of the ranges before."""
    order = [F.col("s_").desc(), F.col(key)]
    rows = cut_lineage(scores.withColumn("s_", F.round("score", 9)).repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))
    # a row per range
    sizes = rows.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    before = sizes.select("part_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    within = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    return rows.withColumn("in_", within).join(F.broadcast(before), "part_").withColumn("rank", F.col("in_") + F.col("before_")).drop("s_", "part_", "in_", "before_")


def subsets(sets: DataFrame, key: str, item: str) -> DataFrame:
    """(key, superset): each key whose items all occur under another key, told by the least keys of their classes of equal sets.

    Keys with equal sets are one class first, by a count and two sums of hashes, and are compared once: of a class the
    keys but the least name the least as their superset; the least key names the least of each class with more items that holds all of its
    own. A class meets only those that hold its rarest item, then the shared items are counted. An empty set has no
    rows and takes no part; NULL keys and items neither.
    """
    items = cut_lineage(sets.select(F.col(key).alias("k"), F.col(item).alias("i")).where("k is not null and i is not null").distinct())
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), "i").cast("decimal(20,0)"))
    sizes = items.groupBy("k").agg(F.count(F.lit(1)).alias("size"), wide(1).alias("h1"), wide(2).alias("h2"))
    least = sizes.groupBy("size", "h1", "h2").agg(F.min("k").alias("rep"))
    members = cut_lineage(sizes.join(least, ["size", "h1", "h2"]).select("k", "rep", "size"))
    heads = members.where("k = rep").select("k", "size")
    held = cut_lineage(items.join(heads.select("k"), "k"))
    often = held.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    rarest = held.join(often, "i").groupBy("k").agg(F.min_by("i", F.struct("n", "i")).alias("i"))
    pairs = rarest.join(held.select(F.col("k").alias("other"), "i"), "i").where("k != other").select("k", "other")
    of = lambda name, n: heads.select(F.col("k").alias(name), F.col("size").alias(n))
    pairs = cut_lineage(pairs.join(of("k", "size"), "k").join(of("other", "other_size"), "other").where("size < other_size").select("k", "other", "size"))
    shared = pairs.join(held, "k").join(held.select(F.col("k").alias("other"), "i"), ["other", "i"]).groupBy("k", "other", "size").agg(F.count(F.lit(1)).alias("shared"))
    equal = members.where("k != rep").select(F.col("k").alias(key), F.col("rep").alias("superset"))
    return equal.unionByName(shared.where("shared = size").select(F.col("k").alias(key), F.col("other").alias("superset")))
