"""Every registered query at sf0.001 against its DuckDB oracle (the correctness gate, locally)."""

import datetime as dt
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from newsloom.sources.tables import TABLES
from tests.conftest import SF_SMALL

# NEWSLOOM_GATE_DIR=/root/testdata/sf0.01 runs the gate at the driver's scale.
GATE_DIR = os.environ.get("NEWSLOOM_GATE_DIR", SF_SMALL)


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, bool):
        return int(v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{GATE_DIR}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["published_date", "source_name", "article_count", "sentiment_ready_count"]


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, GATE_DIR)
    cols = df.columns
    rows = sorted((tuple(_norm(x) for x in r) for r in df.collect()), key=repr)
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert len(cols) > 0
        return
    res = duck.execute(sql)
    dcols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(dcols)
    order = [dcols.index(c) for c in cols]
    drows = sorted((tuple(_norm(r[i]) for i in order) for r in res.fetchall()), key=repr)
    assert rows == drows
