"""Every training-data query with a SQL statement equals it, in all columns, on whole tables."""

import pytest

from sequoria.llm import queries
from tests.compare import duck, rows

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck(sf_dir, SQL[name]))
