"""Every registered engine query against its DuckDB SQL at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from blockloom import file_queries, queries as q, store_queries, stream_queries  # noqa: F401
from blockloom.fixtures import BASE

SF = "/root/testdata/sf0.001"


def rows(df):
    def text(v):
        if v is None or v is pd.NaT or v != v:
            return "~"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(text, r)) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in BASE:
        c.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, duck, name):
    got = q.QUERIES[name](spark, SF).toPandas()
    if name in q.ORACLES:
        want = duck.sql(q.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        got, want = (df.astype({c: float for c in df if df[c].dtype.kind == "f" or str(df[c].dtype) == "Int64"}) for df in (got, want))
        for c in got:
            if want[c].dtype.kind == "f" or got[c].dtype.kind == "f":
                got[c], want[c] = got[c].astype(float), want[c].astype(float)
        assert rows(got) == rows(want)
    else:
        raise AssertionError(f"{name} has no SQL to compare with")
