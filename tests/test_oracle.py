"""Every query of the library's own operators against its SQL, or that it runs where it has none."""

import pytest

from lakesignal import catalog

from .helpers import spark_rows, sql_rows

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == sql_rows(duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 0
