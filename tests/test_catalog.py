"""Every registered query runs; those with a check agree with DuckDB on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import rows_of
from kinforge.fixtures import BASE_TABLES

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def test_entry(spark):
    assert len(entry.entry(spark).take(1)) == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in ORACLE:
        cur = duck.execute(ORACLE[name])
        cols = [c[0] for c in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert rows_of(df.columns, got) == rows_of(cols, cur.fetchall())
