"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~null"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return repr(float(value) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    cursor = duck.execute(ORACLES[name])
    head = [d[0] for d in cursor.description]
    assert sorted(head) == columns
    assert rows == sorted(tuple(plain(r[head.index(c)]) for c in columns) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"train_price_model", "cross_validation"}))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).take(1)


def test_flagship(spark):
    assert entry.entry(spark).count() == 1
