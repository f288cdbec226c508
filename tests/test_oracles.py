"""Every query with SQL against DuckDB on the small tables; the others must run and return rows."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    norm = lambda v: None if v is None else round(float(v), 5) if isinstance(v, float) else str(v)
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _names():
    from lakeloom.plans import catalog

    return sorted(catalog.QUERIES)


@pytest.mark.parametrize("name", _names())
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows(df.columns, got) == _rows(names, found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
