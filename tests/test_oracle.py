"""Registered queries against DuckDB on the smallest tables. By default every seventh query of each family; ALL_QUERIES=1 takes all."""

import math
import os

import duckdb
import pytest

from fleetspan.queries import load

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
QUERIES, SQL = load()
PICKED = [n for i, n in enumerate(sorted(SQL)) if os.environ.get("ALL_QUERIES") or i % 7 == 0]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.fixture(autouse=True)
def as_shipped(spark):
    """Adaptive execution and generated code, as a user's session has them."""
    names = ("spark.sql.adaptive.enabled", "spark.sql.codegen.wholeStage")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "true")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def norm(df):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "<NA>":
            return "NULL"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", PICKED)
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


def test_every_query_is_registered_once_and_oracles_belong_to_queries():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 250
