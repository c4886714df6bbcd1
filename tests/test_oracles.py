"""Every core query against the same statement in SQL, on the smallest tables."""

import pytest

from logloom.plans import problems, problems_sql, reference, reference_sql
from tests.helpers import duck_bag, spark_bag

QUERIES = problems.QUERIES | reference.QUERIES
SQL = problems_sql.SQL | reference_sql.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    want, columns = duck_bag(duck, SQL[name])
    assert sorted(df.columns) == columns
    assert spark_bag(df) == want


def test_every_query_is_registered():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
