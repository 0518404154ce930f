"""Registered queries against their SQL on the smallest test data."""

import math
import pathlib

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
NAMES = sorted(contract.oracle_sql())


def _normal(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return float(value) if hasattr(value, "__float__") else str(value)


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda row: tuple((v is None, str(v)) for v in row)
    return sorted((tuple(_normal(r[i]) for i in order) for r in rows), key=key)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in pathlib.Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, db, name):
    frame = contract.queries()[name](spark, SF)
    cursor = db.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    assert _rows(frame.collect(), frame.columns) == _rows(cursor.fetchall(), names)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
