"""Every registered llm query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from sieveline.llm.queries import QUERIES
from sieveline.llm.sql import SQL

FOLDER = os.environ.get("SIEVELINE_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(norm(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in names)) for r in df.collect())
    if name not in SQL:
        assert got
        return
    r = duck.execute(SQL[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == names
    assert got == sorted(repr(tuple(norm(x[cols.index(c)]) for c in names)) for x in r.fetchall())
