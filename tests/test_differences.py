"""Differing rows against a plain comparison, and what is read for it."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from transhume.plans import differences

RANDOM = random.Random(23)
KIND = "k INT, s STRING, v DOUBLE"


def plain(a, b, n_keys=2):
    left, right = defaultdict(Counter), defaultdict(Counter)
    for rows, side in ((a, left), (b, right)):
        for row in rows:
            side[row[:n_keys]][row] += 1
    out = {}
    for key in {*left, *right}:
        if left[key] != right[key]:
            kind = "added" if not left[key] else "missing" if not right[key] else "changed"
            out[key] = (kind, sum(left[key].values()), sum(right[key].values()))
    return out


def table(n):
    return [(RANDOM.choice([None, *range(n)]), RANDOM.choice([None, "", "x", "y"]), RANDOM.choice([None, 1.0, float("nan")])) for _ in range(n)]


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_same_keys_as_a_plain_comparison(spark, depth):
    a = [r if r[2] == r[2] else (r[0], r[1], 7.0) for r in table(200)]
    b = [(k, s, 5.0) if RANDOM.random() < 0.1 else (k, s, v) for k, s, v in a if RANDOM.random() < 0.9]
    b += RANDOM.choices(a, k=5) + [(1000 + i, "new", None) for i in range(4)]
    source, copy = (spark.createDataFrame(rows, KIND).repartition(3) for rows in (a, b))
    rows = differences.differing_rows(source, copy, ["k", "s"], depth).collect()
    assert {(r["k"], r["s"]): (r["kind"], r["n_source"], r["n_copy"]) for r in rows} == plain(a, b)


def test_equal_and_empty_tables(spark):
    a, none = spark.createDataFrame(table(50), KIND), spark.createDataFrame([], KIND)
    assert differences.differing_rows(a, a, ["k"]).collect() == []
    assert differences.differing_rows(none, none, ["k"]).collect() == []
    kinds = {r["kind"] for r in differences.differing_rows(a, none, ["k"]).collect()}
    assert kinds == {"missing"}
    assert {r["kind"] for r in differences.differing_rows(none, a, ["k"]).collect()} == {"added"}


def test_two_rows_swapped_within_a_key_are_no_difference(spark):
    a = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0)], KIND)
    b = spark.createDataFrame([(1, "a", 2.0), (1, "a", 1.0)], KIND)
    assert differences.differing_rows(a, b, ["k"]).collect() == []
    c = spark.createDataFrame([(1, "a", 2.0), (1, "a", 2.0)], KIND)
    assert [r["kind"] for r in differences.differing_rows(a, c, ["k"]).collect()] == ["changed"]


def test_descent_looks_below_differing_nodes_only(spark, tmp_path):
    a = spark.range(5000).select(F.col("id").cast("int").alias("k"), F.lit("x").alias("s"), F.lit(1.0).alias("v"))
    b = a.where("k <> 77")
    trees = [differences.save_tree(df, ["k"], f"{tmp_path}/{i}") for i, df in enumerate((a, b))]
    (leaf,) = differences.differing_leaves(*trees)
    assert leaf == a.where("k = 77").select(differences.leaf_of(a, ["k"])).first()[0]
    assert trees[0].where("level = 0").first()["n"] == 5000
    assert differences.differing_leaves(trees[0], trees[0]) == []


def scanned(df):
    """Files and rows that the scans of a query read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan, re.findall(r"PartitionFilters: \[[^\]]*_leaf[^\]]*\]", plan)


def test_equal_leaves_of_stored_tables_are_not_read_twice(spark, tmp_path):
    a = spark.range(3000).select(F.col("id").cast("int").alias("k"), F.lit("x").alias("s"), F.col("id").cast("double").alias("v"))
    b = a.withColumn("v", F.when(F.col("k") == 1234, -1.0).otherwise(F.col("v")))
    for name, df in (("a", a), ("b", b)):
        differences.write_by_leaf(df, ["k"], f"{tmp_path}/{name}")
    source, copy = spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/b")
    trees = tuple(differences.save_tree(df, ["k"], f"{tmp_path}/tree-{i}", 2) for i, df in enumerate((source, copy)))
    found = differences.differing_rows(source, copy, ["k"], 2, trees)
    plan, filters = scanned(found)
    assert [(r["k"], r["kind"]) for r in found.collect()] == [(1234, "changed")]
    assert len(filters) >= 2
    read = source.where(F.col("_leaf").isin(differences.differing_leaves(*trees, 2)))
    assert 0 < read.count() < 100 and len(read.select(F.input_file_name()).distinct().collect()) <= 8


def test_rows_of_equal_leaves_end_at_the_scan(spark, tmp_path):
    a = spark.range(3000).select(F.col("id").cast("int").alias("k"), F.lit("x").alias("s"))
    a.write.parquet(f"{tmp_path}/a")
    source = spark.read.parquet(f"{tmp_path}/a")
    found = differences.differing_rows(source, source.where("k <> 5"), ["k"])
    assert [r["k"] for r in found.collect()] == [5]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    first = min(plan.find("Aggregate"), plan.find("Union")) if "Union" in plan else plan.find("Aggregate")
    assert "Filter" in plan[first:]


def test_equal_tables_are_not_read_again(spark):
    a = spark.createDataFrame(table(30), KIND)
    plan = differences.differing_rows(a, a, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Scan" not in plan and "LogicalRDD" not in plan
