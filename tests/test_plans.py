"""Every registered query of the library agrees with its SQL on the small tables."""

import math
import os

import duckdb
import pytest

from platelab.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    return con


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return tuple(map(value, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = [tuple(value(r[c]) for c in columns) for r in got.collect()]
    if name not in registry.ORACLES:
        assert rows
        return
    found = con.execute(registry.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = [tuple(value(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    key = lambda r: [(v is None, str(v)) for v in r]
    assert sorted(rows, key=key) == sorted(want, key=key)
