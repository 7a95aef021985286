"""Every registered query with an oracle, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from rankforge import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return ""
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(bool(v))
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return repr(round(float(v), 4) + 0.0)
    return str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    mine = rows(registry.queries()[name](spark, DATA).toPandas())
    want = rows(duck.execute(registry.oracle_sql()[name]).df())
    assert mine == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_oracle_gives_rows(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0
