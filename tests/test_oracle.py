"""Every query against its SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from factloom.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SMALL}/{name}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    found = catalog.queries()[name](spark, SMALL)
    columns = sorted(found.columns)
    rows = tables.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in rows.fetchall()]
    got = [tuple(plain(r[c]) for c in columns) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
