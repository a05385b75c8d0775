"""Every core query with SQL, over whole tables of the smallest size, against DuckDB."""

import glob
import os

import pytest

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def canonical(columns, rows):
    def value(x):
        if x is None:
            return ""
        if isinstance(x, float):
            return "" if x != x else f"{x:.9g}"
        return str(x).removesuffix(" 00:00:00")

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def check(spark, duck, query, sql):
    df = query(spark, DIR)
    cursor = duck.execute(sql)
    columns = [x[0] for x in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(columns, cursor.fetchall())


def _core():
    from threadloom import queries

    return queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(_core()[1]))
def test_against_sql(spark, duck, name):
    queries, sql = _core()
    check(spark, duck, queries[name], sql[name])


@pytest.mark.parametrize("name", sorted(set(_core()[0]) - set(_core()[1])))
def test_runs(spark, name):
    assert _core()[0][name](spark, DIR).columns
