"""Each catalogued query against its SQL in DuckDB."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from matchlens.plans import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plain(x):
    """Numbers of one kind, rounded; all nulls alike: frames differ in how they hold whole numbers beside nulls."""
    if x is None or x is pd.NA or x != x:
        return None
    return round(float(x), 5) if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) or "Decimal" in type(x).__name__ else x


def canonical(df):
    df = df[sorted(df.columns)]
    rows = [tuple(plain(x) for x in r) for r in df.itertuples(index=False)]
    return list(df.columns), sorted(rows, key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        (gc, gr), (wc, wr) = canonical(got), canonical(want)
        assert gc == wc and len(gr) == len(wr)
        close = lambda a, b: a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and abs(a - b) <= 2e-5)
        bad = [(a, b) for a, b in zip(gr, wr) if not all(close(x, y) for x, y in zip(a, b))]
        assert not bad, bad[:3]
