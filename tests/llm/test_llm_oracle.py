"""Queries of the llm subpackage with SQL give DuckDB's rows."""

import pytest

from lodestream.llm import registry

DATA = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    cur = duck.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(dict(zip(names, r))[c] for c in columns) for r in cur.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == theirs
