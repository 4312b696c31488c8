"""Dashboards declared as data: which query feeds which metric or chart, and a search entry point."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators import charts
from turnloom.operators import search as S
from turnloom.plans.registry import QUERIES

CHARTS = ("bar", "stacked_bar", "line", "area", "pie", "doughnut", "scatter", "heatmap", "table", "word_cloud", "timeline", "number", "radar", "treemap")
MOST_ROWS = 100


@dataclass(frozen=True)
class Part:
    """A metric or chart: the query that feeds it, the column shown and what is done with the rows."""

    id: str
    query: str
    chart: str = "table"
    value: str | None = None
    label: str | None = None
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Dashboard:
    id: str
    title: str
    parts: tuple[Part, ...]


DASHBOARDS = (
    Dashboard("system", "All workspaces", (
        Part("totals", "a01_system_stats", "number"), Part("top_agent", "a02_top_agent", "number", "share_pct", "agent_used"), Part("top_model", "a03_top_model", "number", "share_pct", "model_id"), Part("agentic_time", "a04_agentic_time", "number", "total_ms"),
        Part("by_model", "a05_agentic_time_by_model", "bar", "hours", "model"), Part("by_agent", "a06_agentic_time_by_agent", "bar", "hours", "agent"), Part("velocity", "a07_code_velocity", "line", "net", "day"), Part("productivity", "a08_model_productivity", "bar", "lines_per_turn", "model_id"),
        Part("activity", "a10_heatmap", "heatmap", "total_ms", "bucket"), Part("agents", "a12_agent_distribution", "doughnut", "turns", "agent", {"top": 15}), Part("models", "a13_model_distribution", "pie", "turns", "model_id", {"top": 10}), Part("sessions", "a15_session_timeline", "area", "sessions", "day"),
        Part("languages", "a20_language_evolution", "stacked_bar", "rows", "primary_language"), Part("words", "a23_word_cloud", "word_cloud", "rows", "word"),
    )),
    Dashboard("workspace", "One workspace", (
        Part("folders", "a30_extraction_stats", "table"), Part("starts", "a37_session_starts", "line", "sessions", "day"), Part("tools", "a36_tool_usage", "bar", "uses", "tool", {"top": 15}), Part("list", "a57_session_list", "table"),
    )),
)


def checked(dashboards: tuple[Dashboard, ...] = DASHBOARDS) -> list[str]:
    """What is wrong with the declarations: unknown queries and charts, ids given twice."""
    wrong = []
    for d in dashboards:
        ids = [p.id for p in d.parts]
        wrong += [f"{d.id}: {i} is given twice" for i in sorted({i for i in ids if ids.count(i) > 1})]
        wrong += [f"{d.id}.{p.id}: no query {p.query}" for p in d.parts if p.query not in QUERIES]
        wrong += [f"{d.id}.{p.id}: no chart {p.chart}" for p in d.parts if p.chart not in CHARTS]
    return wrong


def part(spark: SparkSession, folder: str, dashboard: str, id_: str) -> DataFrame:
    """The rows of one part; with an option top the largest labels and the sum of the others."""
    p = next((p for d in DASHBOARDS if d.id == dashboard for p in d.parts if p.id == id_), None)
    if p is None:
        raise ValueError(f"no part {id_} in {dashboard}")
    rows = QUERIES[p.query](spark, folder)
    return charts.top_and_others(rows, p.label, p.value, p.options["top"]) if "top" in p.options else rows


def search(documents: DataFrame, vectors: DataFrame | None = None, text: str = "", query_id: int | None = None, mode: str = "keyword", strict: bool = False, number: int = 1, size: int = 20) -> DataFrame:
    """A page of results (doc_id, score) by keyword, semantic or hybrid search.

    A blank text and an unknown mode are errors; number is at least 1, size between 1 and 100. Semantic results need
    a dot product of 0.3, or 0.5 if strict. query_id names the row of vectors to search with. Hybrid results fuse
    all matches with all such vectors; the page is taken afterwards.
    """
    result = _results(documents, vectors, text, query_id, mode, strict, max(1, number) * max(1, min(MOST_ROWS, size)))
    return charts.page(result, number, size, F.col("score").desc(), F.col("doc_id"))


def search_total(documents: DataFrame, vectors: DataFrame | None = None, text: str = "", query_id: int | None = None, mode: str = "keyword", strict: bool = False) -> int:
    """The number of results on all pages of search; in hybrid mode documents that match or are alike count once."""
    return _results(documents, vectors, text, query_id, mode, strict, None).count()


def found(documents: DataFrame, vectors: DataFrame, text: str, query_id: int, mode: str, strict: bool = False) -> DataFrame:
    """All results (doc_id, score) of search, on whatever page."""
    return _results(documents, vectors, text, query_id, mode, strict, None)


def _results(documents: DataFrame, vectors: DataFrame | None, text: str, query_id: int | None, mode: str, strict: bool, deep: int | None) -> DataFrame:
    """All results (doc_id, score) of a search; of semantic ones the deep best, or all if deep is None."""
    if mode not in ("keyword", "semantic", "hybrid"):
        raise ValueError(f"unknown mode {mode}")
    if mode != "semantic" and not text.strip():
        raise ValueError("nothing to search for")
    keyword = S.bm25(documents, text) if mode != "semantic" else None
    if mode == "keyword":
        return keyword
    if vectors is None or query_id is None:
        raise ValueError("semantic search needs vectors and the id of one of them")
    least, one = 0.5 if strict else 0.3, vectors.where(F.col("vec_id") == query_id)
    if mode == "semantic" and deep is not None:
        return S.nearest(vectors, one, deep, least=least).select(F.col("vec_id").alias("doc_id"), "score")
    semantic = S.alike(vectors, one, least).select(F.col("vec_id").alias("doc_id"), "score")
    return semantic if mode == "semantic" else S.fuse(S.ranked_all(keyword, "doc_id"), S.ranked_all(semantic, "doc_id"), "doc_id")
