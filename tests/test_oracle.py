"""Every core query with SQL gives DuckDB's rows on the smallest tables."""

import collections

import pytest

from conftest import DATA
from lodestream.plans import registry


def plain(v):
    if isinstance(v, float):
        return round(v, 8)
    return str(v) if v is not None and not isinstance(v, (int, bool)) else v


SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cur = duck.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    theirs = collections.Counter(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in cur.fetchall())
    assert ours == theirs
