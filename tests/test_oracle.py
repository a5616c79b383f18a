"""Every registered query with oracle SQL gives the oracle's rows, column names and types."""

import math

import duckdb
import pytest

import __spark_entry__ as driver
from tests.conftest import SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def sortable(row):
    return [(v is None, str(v)) for v in row]


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_same_rows(spark, duck, name):
    ours = driver.queries()[name](spark, SMALL)
    rel = duck.sql(driver.oracle_sql()[name])
    columns = sorted(ours.columns)
    assert columns == sorted(rel.columns)
    theirs_types = dict(zip(rel.columns, map(str, rel.types)))
    assert {c: TYPES[t] for c, t in ours.dtypes} == theirs_types
    left = sorted(([plain(r[c]) for c in columns] for r in ours.collect()), key=sortable)
    order = [rel.columns.index(c) for c in columns]
    right = sorted(([plain(r[i]) for i in order] for r in rel.fetchall()), key=sortable)
    assert len(left) == len(right)
    for a, b in zip(left, right):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-9) if all(isinstance(v, float) for v in a) else a == b


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() == 5
