"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallygrid import queries as base

QUERIES, SQL = base.queries(), base.oracle_sql()


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def assert_same(rows, names, sql, sf_dir):
    db = duckdb.connect()
    for f in os.listdir(sf_dir):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    found = db.execute(sql)
    order = [d[0] for d in found.description]
    assert sorted(order) == sorted(names)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    ours = sorted((tuple(cell(r[c]) for c in sorted(names)) for r in rows), key=key)
    theirs = sorted((tuple(cell(v) for _, v in sorted(zip(order, r, strict=True))) for r in found.fetchall()), key=key)
    assert ours == theirs


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert_same(df.collect(), df.columns, SQL[name], sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
