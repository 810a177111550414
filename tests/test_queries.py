"""Every query with a SQL statement equals it on whole tables; the others run."""

import pytest

from sequoria.plans import registry
from tests.compare import duck, rows

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck(sf_dir, SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["a", "b", "n"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
