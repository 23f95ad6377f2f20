"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in sorted(os.listdir(FOLDER)):
        table = name.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else int(value) if value == int(value) else value
    return value


def normal(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(
        (tuple(plain(row[i]) for i in order) for row in rows),
        key=lambda row: [(v is None, str(v)) for v in row],
    )


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER)
    rows = got.collect()
    assert rows
    if name in ORACLES:
        want = duck.execute(ORACLES[name])
        names = [column[0] for column in want.description]
        assert sorted(names) == sorted(got.columns)
        assert normal(got.columns, rows) == normal(names, want.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
