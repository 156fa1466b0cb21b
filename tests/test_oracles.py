"""Every query with SQL against DuckDB on the smallest driver tables."""

from __future__ import annotations

import datetime
import math
import os

import duckdb
import pytest

from sparkloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return str([plain(x) for x in v]) if isinstance(v, list) else str(v)


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in catalog.ORACLES:
        assert rows
        return
    found = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in at) for r in found.fetchall()]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(entry.SMOKE_DIR):
        assert entry.entry(spark).count() > 0
