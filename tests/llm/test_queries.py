"""The corpus queries that SQL can express, against their SQL over the smallest synthetic tables."""

import os

import pytest

from tidemark.llm import queries as Q

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.sql(Q.SQL[name])
    df = Q.QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted(map(str, df.select(*want.columns).collect()))
    names = want.columns
    assert got == sorted("Row(" + ", ".join(f"{n}={v!r}" for n, v in zip(names, r, strict=True)) + ")" for r in want.fetchall())
