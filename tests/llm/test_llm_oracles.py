import pytest
from test_oracles import DIR, check, duck  # noqa: F401

from threadloom.llm import queries


def test_names():
    assert {n.split("_")[0] for n in queries.queries()} == {f"p{k}" for k in range(1, 11)} - {"p7"}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, name):  # noqa: F811
    check(spark, duck, queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, name):
    assert queries.queries()[name](spark, DIR).columns
