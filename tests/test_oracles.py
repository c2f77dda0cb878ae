"""Every query with SQL against DuckDB on the smallest tables."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from quillfund.plans.views import TABLES

DATA = "/root/testdata/sf0.001"
SQL = {name: sql for module in entry.MODULES if "llm" not in module.__name__ for name, sql in module.ORACLE_SQL.items()}


@pytest.fixture(scope="module")
def duck():
    with duckdb.connect() as con:
        for name in TABLES:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
        yield con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return None if math.isnan(value) else round(float(value), 5) + 0.0
    if isinstance(value, (dt.date, dt.datetime)):
        return str(value)[:10]
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    found = entry.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    told = duck.execute(SQL[name])
    names = [c[0] for c in told.description]
    assert sorted(names) == columns
    got = sorted(repr([plain(row[c]) for c in columns]) for row in found.collect())
    assert got == sorted(repr([plain(row[names.index(c)]) for c in columns]) for row in told.fetchall())


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[:3] == ["request_id", "share_code", "start_used"]
