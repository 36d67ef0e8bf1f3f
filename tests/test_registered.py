"""Every registered query against its SQL, on the smallest tables."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from trapline.checks import all_checks

@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in all_checks().items() if sql))
def test_same_rows_as_sql(name, spark, sf_dir, con):
    assert difference(entry.queries()[name](spark, sf_dir), con, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in all_checks().items() if sql is None))
def test_runs(name, spark, sf_dir):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0
    assert rows.columns == entry.entry(spark).columns
