"""Every query with SQL gives the SQL's rows on the smallest data."""

from __future__ import annotations

import pytest

from terravane.plans import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(name, spark, duck, data, same):
    assert same(QUERIES[name](spark, data).toPandas(), duck.sql(ORACLE[name]).df())


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
