"""Every registered query of the reference's operators against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from scimap.plans import registry

SF = "/root/testdata/sf0.001"


def show(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for file in os.listdir(SF):
        name = file.removesuffix(".parquet")
        c.execute(f"create view {name} as select * from read_parquet('{SF}/{file}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    rows, columns = df.collect(), df.columns
    if name not in registry.ORACLES:
        assert rows
        return
    got = con.execute(registry.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(columns)
    want = sorted(tuple(show(r[names.index(c)]) for c in sorted(names)) for r in got.fetchall())
    assert sorted(tuple(show(r[c]) for c in sorted(columns)) for r in rows) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
