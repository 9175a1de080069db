"""Every registered query that has a SQL twin against DuckDB on the smallest tables, and the documented slice."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from ordeval import queries as core

SF = "/root/testdata/sf0.001"
SQL = core.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def shown(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.6g}" if isinstance(v, float) else str(v)  # whole numbers exactly


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    got = core.queries()[name](spark, SF)
    want = db.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    a = sorted([shown(r[c]) for c in order] for r in got.collect())
    b = sorted([shown(dict(zip(names, r, strict=True))[c]) for c in order] for r in want.fetchall())
    assert a == b


def test_documented_slice(spark):
    rows = {(r["role"], r["model"]): r for r in __spark_entry__.entry(spark).collect()}
    a = rows["test", "A"]
    assert a["n"] == 122 and a["macro_f1"] == pytest.approx(0.269901458) and a["qwk"] == pytest.approx(-0.035703891)
    assert rows["test", "B"]["mean_asymmetric_cost"] == pytest.approx(0.62295082)


def test_unverifiable_queries_give_rows(spark):
    for name in sorted(set(core.queries()) - set(SQL)):
        assert core.queries()[name](spark, SF).count() > 0, name
