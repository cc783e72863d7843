import duckdb
import pytest

from cairnmill.llm import queries

RUN, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(RUN))
def test_query(spark, sf, name):
    got = RUN[name](spark, sf)
    rows = got.collect()
    assert rows
    if name in SQL:
        con = duckdb.connect()
        for t in ("chunks", "documents"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        assert sorted(map(str, (tuple(r) for r in rows))) == sorted(map(str, con.execute(SQL[name]).fetchall()))
