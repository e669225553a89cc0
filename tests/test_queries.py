"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of, same_type
from labspark.workload import ORACLES, QUERIES

ROWS_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def db(sf):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return db


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, sf, name):
    df = QUERIES[name](spark, sf)
    mine = rows_of(df.columns, df.collect())
    assert mine
    if name in ROWS_ONLY:
        return
    cursor = db.execute(ORACLES[name])
    types = {d[0]: str(d[1]) for d in cursor.description}
    assert sorted(types) == sorted(df.columns)
    assert [(c, t, types[c]) for c, t in df.dtypes if not same_type(t, types[c])] == []
    assert mine == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["prefix", "frequency"]
