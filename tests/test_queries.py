"""Every registered query of the engine, against its SQL on the small tables."""

import glob
import math
import os

import duckdb
import pytest
from extractspark import queries

FOLDER = "/root/testdata/sf0.001"
KNOWN, SQL = queries.queries(), queries.oracle_sql()
#: Types that occur in no document of the smallest table.
MAY_BE_EMPTY = {"typed_percentage", "typed_email", "typed_mention", "typed_ip_address", "typed_phone", "typed_number"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def test_all_sql_has_its_query():
    assert set(SQL) <= set(KNOWN)


@pytest.mark.parametrize("name", sorted(KNOWN))
def test_query(spark, duck, name):
    got = KNOWN[name](spark, FOLDER)
    rows = sorted(repr(tuple(r[c] for c in sorted(got.columns))) for r in got.collect())
    assert rows or name in MAY_BE_EMPTY
    if name in SQL:
        found = duck.sql(f"select {', '.join(sorted(got.columns))} from ({SQL[name]})").fetchall()
        assert rows == sorted(repr(tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r)) for r in found)
    spark.catalog.clearCache()
