"""Every query against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from skyframes.plans import catalog

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v + 0.0, 5)
    return v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got
    if name not in catalog.oracle_sql():
        return
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    r = c.sql(catalog.oracle_sql()[name])
    at = [list(r.columns).index(x) for x in columns]
    assert sorted(r.columns) == columns
    want = sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=repr)
    assert len(got) == len(want)
    off = [(a, b) for a, b in zip(got, want, strict=True) if any(x != y and not (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-5) for x, y in zip(a, b, strict=True))]
    assert not off, off[:3]
