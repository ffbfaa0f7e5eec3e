"""Every registered query against its SQL, on the smallest tables."""

import pytest

from codefindings import catalog
from tests.oracle import connect, compare

QUERIES = catalog.queries()


@pytest.fixture(scope='module')
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize('name', sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf, name):
    problem = compare(spark, duck, name, QUERIES[name], catalog.oracle_sql().get(name), sf)
    assert problem in (None, 'no rows'), problem


def test_entry_runs(spark):
    import __spark_entry__
    assert __spark_entry__.entry(spark).count() > 0


# Nesting and block ends have no SQL: tests/test_pysource.py holds them against Python's own parser.
WITHOUT_SQL = {'py_structure'}


def test_everything_has_sql():
    assert set(QUERIES) - WITHOUT_SQL == set(catalog.oracle_sql())
