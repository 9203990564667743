"""Every query equals its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import differences
from sample_queries.queries import QUERIES

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no sample tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


# whole maps at 0.1 degree: see test_default_grid in test_pixels_and_places.py
NO_SQL = {"map_stats_tenth"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - NO_SQL))
def test_query_equals_sql(spark, tables, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = tables.execute(entry.oracle_sql()[name]).fetchdf()
    assert differences(got, want) == ""


def test_every_query_has_sql():
    assert set(QUERIES) - NO_SQL <= set(entry.oracle_sql())
