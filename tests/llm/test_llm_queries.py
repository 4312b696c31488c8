import pytest

from tests.compare import duck_rows, rows
from turnloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, small, duck, name):
    assert rows(queries.QUERIES[name](spark, small)) == duck_rows(duck, queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, small, name):
    assert queries.QUERIES[name](spark, small).count() >= 0


def test_mix_and_report_fit(spark, small):
    """The report adds up to the picks, keeps to the repeats and reaches its targets to within a document."""
    picks, report = queries.p9_mix(spark, small).collect(), {r.source: r for r in queries.p9_report(spark, small).collect()}
    documents = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    most = {r.source: r.max_repeats for r in spark.read.parquet(f"{small}/mix_targets.parquet").collect()}
    assert picks and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-6
    for p in picks:
        assert documents[p.doc_id].source == p.source and 1 <= p.copies <= most[p.source]
    for s, r in report.items():
        assert sum(p.tokens * p.copies for p in picks if p.source == s) == r.mixed_tokens
        own = [p.tokens for p in picks if p.source == s]
        assert not own or r.target_tokens - r.mixed_tokens <= max(len(t.text or "") for t in documents.values() if t.source == s)


def test_ids_of_every_document(spark, small):
    from turnloom.llm import tokens

    got = {r.doc_id: r.ids for r in queries.p8_ids(spark, small).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    assert set(got) == set(texts) and all(tokens.decode(got[i]).decode() == (t or "") for i, t in texts.items())
