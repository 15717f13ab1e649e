"""Every query with SQL gives DuckDB's rows, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from sessionloom.plans import oracle, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(
        tuple("null" if pd.isna(v) else str(round(float(v), 6)) if not isinstance(v, str) else v for v in r)
        for r in frame.itertuples(index=False)
    )


@pytest.mark.parametrize("name", list(oracle.FINAL))
def test_same_rows(spark, duck, name):
    got = queries.queries()[name](spark, FOLDER).toPandas()
    want = duck.execute(oracle.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
