import duckdb
import pytest

from test_oracle import DATA, QUERIES, SQL, TABLES, rows_of


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["compose_provenance", "session_counts", "sliding_counts"])
def test_query_with_reserved_column_names_equals_sql(spark, duck, name):
    """Their columns are key words of SQL (end, start ...), so the names are quoted."""
    frame = QUERIES[name](spark, DATA)
    cols = sorted(frame.columns)
    assert sorted(duck.sql(SQL[name]).columns) == cols
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = duck.sql(f"SELECT {quoted} FROM ({SQL[name]})").fetchall()
    assert want and rows_of(frame.select(*cols).collect()) == rows_of(want)
