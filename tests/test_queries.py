"""Every core query against its SQL oracle on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if "datetime" in str(df[c].dtype):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA else v)
        else:
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    if name not in queries.ORACLES:
        assert len(got.columns)
        return
    want = duck.sql(queries.ORACLES[name]).df()
    a, b = rows(got), rows(want)
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        if a[c].dtype == object:
            assert (a[c].fillna("∅") == b[c].fillna("∅")).all(), c
        else:
            assert np.allclose(a[c], b[c], atol=2e-6, rtol=1e-9, equal_nan=True), c
