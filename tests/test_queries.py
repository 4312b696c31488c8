"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import duck_rows, rows
from turnloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_sql(spark, small, duck, name):
    assert rows(catalogue.QUERIES[name](spark, small)) == duck_rows(duck, catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() >= 0


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns
