"""Registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from lectern.plans.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return v if v is None or isinstance(v, (str, bool)) else float(v) if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in SQL:
        assert df.columns
        return
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    theirs = sorted(str([plain(r[columns.index(c)]) for c in order]) for r in want.fetchall())
    assert sorted(str([plain(r[c]) for c in order]) for r in rows) == theirs
