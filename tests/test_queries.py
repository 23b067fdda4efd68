import pytest

from sievelake import queries

from .oracle import same


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert same(spark, queries.QUERIES[name], queries.SQL[name])
