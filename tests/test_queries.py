"""Registered queries against their comparison SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

from conftest import SF

#: Every comparison query outside the training-data package, whose tests stand beside it.
NAMES = [n for m in entry._MODULES for n in m.ORACLES]


def plain(df):
    import pandas as pd

    def cell(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return "NULL"
        return f"{float(v):.6f}" if pd.api.types.is_number(v) and not isinstance(v, bool) else str(v)

    columns = sorted(df.columns)
    return columns, sorted(tuple(cell(v) for v in row) for row in df[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    assert plain(entry.queries()[name](spark, SF).toPandas()) == plain(duck.sql(entry.oracle_sql()[name]).df())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "salary_min" in df.columns


def test_streams(spark):
    for name in ("j2_stream_changed_feed", "j4_stream_lease_timeout", "j5_windowed_intake"):
        assert entry.queries()[name](spark, SF).count() > 0
