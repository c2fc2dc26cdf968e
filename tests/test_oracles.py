"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as contract
from compare import differences, open_tables
from scanlytics.registry import queries as registered

QUERIES = contract.queries()
ORACLES = contract.oracle_sql()


def test_every_query_has_sql():
    assert set(registered.queries()) <= set(ORACLES)


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_matches_sql(spark, folder, name):
    with open_tables(folder) as con:
        assert differences(QUERIES[name](spark, folder), con, ORACLES[name]) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0
