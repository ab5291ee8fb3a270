"""Every registered query against its checking SQL on the smallest tables."""

import pytest
from compare import difference, open_tables

from oracle.sql import STATEMENTS
from ticketloom.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(small):
    return open_tables(small)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(STATEMENTS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, small, name):
    assert difference(QUERIES[name](spark, small), con, STATEMENTS[name]) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(STATEMENTS) <= set(entry.oracle_sql()) <= set(entry.queries())
