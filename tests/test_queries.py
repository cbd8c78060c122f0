import pytest

import __spark_entry__ as entry
from predlens.plans import monitor_queries, queries as own  # noqa: F401 (registers its queries with the others)

from .compare import same
from .conftest import DATA


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(own.QUERIES[name](spark, DATA), own.ORACLES[name], DATA)


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert own.QUERIES[name](spark, DATA).limit(5).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
