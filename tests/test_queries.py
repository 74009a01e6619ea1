"""Every registered query of the engine against its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from casewright.plans import queries as plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(value):
    if isinstance(value, decimal.Decimal | float):
        value = float(value)
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in plans.ORACLE:
        assert got
        return
    want = con.execute(plans.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert ordered(df.columns, got) == ordered(columns, want.fetchall())
