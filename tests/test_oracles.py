"""Every registered query against its SQL equivalent, run by DuckDB on the same files."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_point

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def rows_of(frame):
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        return v.item() if hasattr(v, "item") else v

    found = [tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None)]
    return sorted(found, key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got), rows_of(want)
    assert len(a) == len(b) and len(a) > 0
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    out = entry_point.entry(spark)
    assert out.count() == 1000 - 7
    assert [f.name for f in out.schema.fields] == ["idx", "flow_id", "Attack", "win"]
