"""Every registered query of the library's own catalogue against its SQL."""

import compare
import pytest

import __spark_entry__ as entry

from reprise.plans import catalog, oracle

QUERIES, ORACLE = catalog.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert compare.compare(spark, con, QUERIES[name], ORACLE[name], sf_dir) is None
