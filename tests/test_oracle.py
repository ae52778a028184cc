"""Every query with SQL gives the rows that DuckDB gives on the same tables; the others give rows."""

import datetime
import glob
import math
import os

import duckdb
import pytest

import docslice.plans.entries as entries


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(entries.QUERIES))
def test_query(spark, sf, con, name):
    df = entries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted((tuple(norm(x) for x in r) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=str)
    if name not in entries.ORACLE_SQL:
        assert columns
        return
    got = con.execute(entries.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted((tuple(norm(x[i]) for i in order) for x in got.fetchall()), key=str)
