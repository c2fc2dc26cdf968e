"""The registered text queries that have SQL, against it."""

import pytest

from compare import differences, open_tables
from scanlytics.llm import queries as text

SQL = text.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, folder, name):
    with open_tables(folder) as con:
        assert differences(text.queries()[name](spark, folder), con, SQL[name]) is None
