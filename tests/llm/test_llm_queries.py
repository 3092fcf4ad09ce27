import pytest

from strata.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_same_as_sql(spark, small, same, name):
    same(q.QUERIES[name](spark, small), q.SQL[name])


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_runs(spark, small, name):
    df = q.QUERIES[name](spark, small)
    assert df.columns and df.count() > 0
