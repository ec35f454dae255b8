"""Every registered query equals its DuckDB oracle (row multiset, names) at sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF001
from tools.check_oracle import TABLES, rows_of

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 7
    assert set(df.columns) >= {"category", "count", "sample_indices"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF001)
    scols, srows = df.columns, [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert srows is not None
        return
    cur = duck.execute(ORACLE[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(scols) == sorted(dcols)
    assert rows_of(scols, srows) == rows_of(dcols, cur.fetchall())
