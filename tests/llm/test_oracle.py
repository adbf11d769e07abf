"""Queries of this subpackage with SQL against DuckDB."""

import pytest

from skyweave.llm import queries
from tests.test_queries import duck, plain  # noqa: F401 (fixture)

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, duck, name):  # noqa: F811
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(x) for x in r) for r in got.select(*columns).collect())
    want = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns and rows
    order = [names.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[k]) for k in order) for r in want.fetchall())
