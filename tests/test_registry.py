"""Every registered media query with SQL agrees with DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from orrery import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    rows = lambda all_rows, names: sorted(repr(tuple(value(r[names.index(c)]) for c in columns)) for r in all_rows)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)
