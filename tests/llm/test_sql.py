"""Queries of this subpackage against their SQL on the smallest tables."""

import pytest

from factloom.llm import queries
from tests.test_oracle import SMALL, plain, tables  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, tables, name):  # noqa: F811
    found = queries.queries()[name](spark, SMALL)
    columns = sorted(found.columns)
    rows = tables.execute(queries.oracle_sql()[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in rows.fetchall()]
    got = [tuple(plain(r[c]) for c in columns) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
