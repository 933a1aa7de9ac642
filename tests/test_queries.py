"""Every registered query of the library against its SQL, on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from postmill.plans import registry
from postmill.plans.session import ship


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, datetime.date):
        return datetime.datetime(v.year, v.month, v.day).isoformat()
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, sf, name):
    if name == "classifier_scores":
        pytest.skip("trained in test_pipeline")
    df = registry.queries()[name](ship(spark), sf)
    cols = sorted(df.columns)
    rows = sorted(tuple(str(plain(r[c])) for c in cols) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert sorted(tuple(str(plain(r[names.index(c)])) for c in cols) for r in found.fetchall()) == rows
