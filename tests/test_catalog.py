"""Every query of the catalogue at the smallest scale, against its SQL."""

from __future__ import annotations

import os

import duckdb
import pytest
from __spark_entry__ import entry
from check import TABLES, normalise

from tonegrain.plans.catalog import QUERIES
from tonegrain.plans.oracle import ORACLE

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not there")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry(spark).columns[0] == "row_id"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    got = normalise(QUERIES[name](spark, SF_DIR).toPandas())
    want = normalise(con.sql(ORACLE[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert got.equals(want)
