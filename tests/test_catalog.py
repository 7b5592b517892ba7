"""Every registered query against its oracle on the smallest driver tables."""

import os

import pytest

from vitalframe.plans import catalog

FOLDER = "/root/testdata/sf0.001"
SLOW = ("wave_", "ppg_features", "nested_cv", "imf_features", "ecg_features")


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or isinstance(v, float) and v != v:
        return "NULL"
    return repr(round(float(v), 5) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, name):
    got = catalog.queries()[name](spark, FOLDER)
    want = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    theirs = sorted(tuple(plain(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())
    assert mine == theirs


def test_every_query_without_an_oracle_runs(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("the driver's tables are absent")
    for name in sorted(set(catalog.queries()) - set(catalog.oracle_sql())):
        if not name.startswith(SLOW):
            assert catalog.queries()[name](spark, FOLDER).count() > 0
