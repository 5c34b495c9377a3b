"""Every query against its SQL on the smallest tables; the rest run."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from mnemis.plans.oracles import ORACLES
from mnemis.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return c


def _rows(rows):
    plain = [tuple(float(x) + 0.0 if type(x).__name__ in ("float", "Decimal") else x for x in r) for r in rows]
    return sorted(plain, key=lambda t: tuple((x is None, "" if x is None else x) for x in t))


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = _rows(tuple(r) for r in df.select(*columns).collect())
    assert got
    if name in ORACLES:
        r = duck.sql(ORACLES[name])
        assert sorted(r.columns) == columns
        assert got == _rows(tuple(x[r.columns.index(c)] for c in columns) for x in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert {*ORACLES} <= {*QUERIES} <= {*entry.queries()}
