"""Every query of the core that has SQL gives the rows that DuckDB gives for it."""

import pytest

from tests.compare import duck, rows
from weftline.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows(spark, data, name):
    ours = rows(catalogue.QUERIES[name](spark, data).toPandas())
    theirs = rows(duck(data).sql(catalogue.SQL[name]).df())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() >= 0


def test_every_sql_has_a_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
