"""Each registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from quarry.plans.queries import ORACLES, QUERIES

DATA = os.environ.get("QUARRY_DATA", "/root/testdata/sf0.001")
TABLES = ["orders", "lineitem", "events", "documents", "benchmark", "customer"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    clean = [tuple(round(r[i], 6) if isinstance(r[i], float) and not math.isnan(r[i]) else r[i] for i in order) for r in rows]
    return sorted(columns), sorted(clean, key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    expected = duck.sql(ORACLES[name])
    assert _plain([tuple(r) for r in df.collect()], df.columns) == _plain(expected.fetchall(), expected.columns)
