"""Every catalogue query against its SQL."""

import os

import duckdb
import pytest

from thicket import catalogue, catalogue_details  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        path = f"{DATA}/{f}"
        c.execute(f"create view {f.split('.')[0]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    if name not in catalogue.ORACLE_SQL:
        pytest.skip("no SQL")
    df, want = catalogue.QUERIES[name](spark, DATA), con.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = lambda found, of: sorted(repr(tuple(plain(of(r, c)) for c in sorted(want.columns))) for r in found)
    at = {c: i for i, c in enumerate(want.columns)}
    assert rows(df.collect(), lambda r, c: r[c]) == rows(want.fetchall(), lambda r, c: r[at[c]])
