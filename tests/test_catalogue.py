import os

import duckdb
import pandas as pd
import pytest

from skein import catalogue

DATA = "/root/testdata/sf0.001"


def plain(v):
    return "null" if v is None or v is pd.NaT else f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(df):
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert rows(catalogue.queries()[name](spark, DATA).toPandas()) == rows(con.execute(catalogue.oracle_sql()[name]).df())
