import duckdb
import pytest

import __spark_entry__
from fenestra.plans import blocks, oracle, queries

SQL = oracle.oracle_sql() | blocks.oracle_sql()
QUERIES = queries.queries() | blocks.queries()

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows_of(rows):
    return sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    cols = sorted(frame.columns)
    sql = duck.sql(SQL[name])
    assert sorted(sql.columns) == cols
    want = duck.sql(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()
    assert rows_of(frame.select(*cols).collect()) == rows_of(want)


def test_queries_without_sql_run(spark):
    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, DATA).count() > 0, name


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
