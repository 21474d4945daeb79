"""Every query against its SQL, over whole tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from symdex import queries


def plain(v):
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(plain(x) for x in v)
    if pd.isna(v):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)


def rows(df):
    names = sorted(df.columns)
    return sorted(repr(tuple(plain(v) for v in row)) for row in df[names].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sf_dir, duck, name):
    got = queries.queries()[name](spark, sf_dir).toPandas()
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got)
