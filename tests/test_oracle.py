"""Every registered relational query against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tessel.plans.queries import ORACLE, QUERIES

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _cell(x):
    return round(x, 6) + 0.0 if isinstance(x, float) and math.isfinite(x) else x


@pytest.mark.skipif(not SF.exists(), reason="the test tables are not there")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    want = duck.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    got = sorted((tuple(_cell(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(_cell, r)) for r in want.fetchall()), key=repr)
