"""Every catalogued query against its DuckDB statement."""

import math
import os

import duckdb
import pytest

from keystrata.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


def rows(df):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        if hasattr(v, "tolist"):
            return one(v.tolist())
        return tuple(map(one, v)) if isinstance(v, (list, tuple)) else v

    names = sorted(df.columns)
    out = df[names].astype(object).where(df[names].notna(), None)
    return names, sorted((str(tuple(one(v) for v in r)) for r in out.itertuples(index=False)))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, db, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(db.sql(ORACLES[name]).df())
