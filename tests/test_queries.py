import pytest

from quaver import catalog_queries as cq
from tests.compare import same


@pytest.mark.parametrize("name", sorted(cq.SQL))
def test_equals_sql(spark, small, name):
    same(cq.QUERIES[name](spark, small), cq.SQL[name], small)


@pytest.mark.parametrize("name", sorted(set(cq.QUERIES) - set(cq.SQL)))
def test_runs(spark, small, name):
    assert cq.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 16
    assert set(entry.oracle_sql()) <= set(entry.queries())
