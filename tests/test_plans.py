"""Every registered query against its oracle, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from filigree.plans import registry
from filigree.sources.views import TABLES


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6) if abs(v) < 1e6 else float(f"{v:.10g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_oracle(spark, sf_dir, duck, name):
    found = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in found.collect())
    if name not in registry.ORACLES:
        assert rows
        return
    told = duck.sql(registry.ORACLES[name])
    assert sorted(told.columns) == columns
    place = [told.columns.index(c) for c in columns]
    assert rows == sorted(repr(tuple(plain(r[i]) for i in place)) for r in told.fetchall())
