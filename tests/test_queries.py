"""Every registered query against its SQL, on the whole given tables."""

import os

import pytest
from compare import database, differences

import __spark_entry__ as entry
from workload.registry import QUERIES, SQL

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    assert differences(df, con, entry.oracle_sql()[name]) == []


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries())


def test_entry_counts_all_assets(spark):
    rows = entry.entry(spark).collect()
    n_docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert sum(row["n_assets"] for row in rows) == n_docs
