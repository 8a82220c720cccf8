"""Indexed searches give the rows of plain ones and read their own folders only."""

import random
import re

import pytest

from transhume.operators import filters, search_index

RANDOM = random.Random(5)
KIND = "path STRING, name STRING, owner STRING, id LONG, run STRING"
PARTS = ["ab", "Abc", "/", "é", "É", "x", "\U0001f600", "日本", "_", "%", "\n", "İ", "Σ"]


def word():
    return RANDOM.choice([None, "", *["".join(RANDOM.choice(PARTS) for _ in range(RANDOM.randrange(1, 9)))] * 6])


ROWS = [(word(), word(), word(), i // 2, word()) for i in range(300)]
ROWS += ROWS[:20] + [(None, None, None, None, None), ("/hot/abc", "abc", "abc", 1, None)] * 100


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index")) + "/search"
    df = spark.createDataFrame(ROWS, KIND).repartition(3)
    search_index.build(df, path)
    return df, path


QUERIES = ["a", "AB", "abc", "bca", "é", "É/x", "\U0001f600", "日本_", "\n", "%", "abcabc", "absent text", "İ", "Σ", "", "/hot/ABC"]


@pytest.mark.parametrize("query", QUERIES)
def test_same_rows_as_a_plain_search(spark, indexed, query):
    df, path = indexed
    found = search_index.search(spark, path, query, df.schema)
    assert found.columns == df.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, filters.search(df, query).collect()))


def test_some_of_the_fields(spark, indexed):
    df, path = indexed
    found = search_index.search(spark, path, "abc", df.schema, ["owner"])
    assert sorted(map(str, found.collect())) == sorted(map(str, filters.search(df, "abc", ["owner"]).collect()))


def test_reads_folders_of_its_runs_only(spark, indexed):
    _, path = indexed
    found = search_index.candidates(spark, path, "abcx")
    folders = {int(f) for f in re.findall(r"folder=(\d+)", " ".join(found.inputFiles()))}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*folder#\d+ IN \(\d+,\d+\)", plan)
    assert re.search(r"PushedFilters: \[In\(run, \[abc,bcx\]\)", plan)
    assert len(re.findall("FileScan", plan)) == 1 and len(folders) > 0


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], KIND)
    search_index.build(df, f"{tmp_path}/none")
    assert search_index.search(spark, f"{tmp_path}/none", "a", df.schema).collect() == []
    assert search_index.search(spark, f"{tmp_path}/none", "", df.schema).collect() == []
