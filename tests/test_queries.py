"""Every query with SQL against DuckDB on the smallest tables; entry() and names."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from cairnmill.plans import core_problems, reference_queries

SQL = {**core_problems.oracle_sql(), **reference_queries.oracle_sql()}
RUN = {**core_problems.queries(), **reference_queries.queries()}


def cell(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return [cell(x) for x in v]
    return str(v)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, db, name):
    df = RUN[name](spark, sf)
    cols = sorted(df.columns)
    mine = sorted(str([cell(r[c]) for c in cols]) for r in df.collect())
    cur = db.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert mine == sorted(str([cell(r[names.index(c)]) for c in cols]) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(RUN) - set(SQL)))
def test_runs(spark, sf, name):
    df = RUN[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(RUN) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
