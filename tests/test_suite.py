"""Every named query against its SQL, over the smallest synthetic tables."""

import decimal
import os

import pytest

from tidemark import suite, suite_writes

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in suite.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    return str(v)


QUERIES = suite.queries() | suite_writes.queries()
SQL = suite.oracle_sql() | suite_writes.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    want = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [df.columns.index(c) for c in want.columns]
    got = sorted(tuple(_plain(r[i]) for i in at) for r in df.collect())
    assert got == sorted(tuple(map(_plain, r)) for r in want.fetchall())


def test_flagship(spark):
    assert suite.flagship(spark, FOLDER).count() > 0
