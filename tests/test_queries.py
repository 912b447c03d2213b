"""Every registered query against its DuckDB SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from palmleaf.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def same(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    assert sorted(a.columns) == sorted(b.columns)
    text = lambda v: "-" if pd.isna(v) else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    rows = lambda df: sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    return rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE:
        assert same(got, duck.execute(registry.ORACLE[name]).df())
    else:
        assert len(got)
