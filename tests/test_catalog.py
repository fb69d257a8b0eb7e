"""Each registered query with SQL against DuckDB on the smallest tables, and the entry module."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from lectern.plans import ORACLES, QUERIES, fixtures

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in fixtures.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return str(list(v))
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return None
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (float, np.floating)) and float(v).is_integer() and abs(v) < 2**53:
        return str(int(v))  # whole numbers beside nulls come as floats
    if isinstance(v, (float, np.number)):
        return f"{float(v):.9g}"
    return str(v).replace(" 00:00:00", "")


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted([tuple(map(plain, r)) for r in df[cols].astype(object).itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    got, want = rows(QUERIES[name](spark, SF).toPandas()), rows(con.sql(ORACLES[name]).df())
    assert got == want and want[1], "an empty result proves nothing"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
