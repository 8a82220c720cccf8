"""Input order: ordinals of listed items, and the operators that ask for them, straight from the readers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from transhume.operators import cost, filters, joins, scan
from transhume.plans import reports
from transhume.sources import listings, ordinals

RANDOM = random.Random(11)


def pages_of(tmp_path, name, array, items, files=5, upto=4):
    """The items in files of pages of up to so many, in order; some pages are empty, some lack the array."""
    folder = tmp_path / name
    folder.mkdir()
    cuts = sorted(RANDOM.sample(range(1, len(items)), files - 1))
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(items)])):
        with open(folder / f"page-{n:03}.json", "w") as out:
            while a < b:
                k = min(RANDOM.randint(0, upto), b - a)
                out.write(json.dumps({array: items[a : a + k]}) + "\n")
                if RANDOM.random() < 0.2:
                    out.write(RANDOM.choice(['{"other": 1}', "{broken", "{}"]) + "\n")
                a += k
    return str(folder)


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def clusters(n):
    return [{"cluster_id": f"c{RANDOM.randint(0, n)}", "num_workers": i, "node_type_id": "i3.large"} for i in range(n)]


@pytest.mark.parametrize("n", [2, 40, 700])
def test_ordinals_follow_the_files(spark, tmp_path, small_blocks, n):
    items = clusters(n)
    path = pages_of(tmp_path, "clusters", "clusters", items, files=min(5, n))
    rows = listings.read_clusters(spark, path).collect()
    assert sorted((r["ord"], r["cluster_id"], r["num_workers"]) for r in rows) == [
        (i, c["cluster_id"], c["num_workers"]) for i, c in enumerate(items)
    ]
    if n == 700:
        blocks = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
        assert blocks > 10


def test_whole_files_count_as_one_block(spark, tmp_path):
    for i in range(4):
        page = {"clusters": [{"cluster_id": f"c{i}{j}"} for j in range(3)]}
        (tmp_path / f"page{i}.json").write_text(json.dumps(page, indent=2))
    rows = listings.read_clusters(spark, str(tmp_path), multi_line=True).collect()
    assert [r["cluster_id"] for r in sorted(rows, key=lambda r: r["ord"])] == [f"c{i}{j}" for i in range(4) for j in range(3)]


def test_nothing_listed(spark, tmp_path):
    (tmp_path / "page.json").write_text('{"clusters": []}\n{}\n')
    rows = listings.read_clusters(spark, str(tmp_path))
    assert "ord" in rows.columns and rows.collect() == []


def test_running_totals(spark):
    values = [(RANDOM.choice("abc"), i, RANDOM.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(values, "k STRING, i INT, v INT").repartition(7)
    got = {(r["k"], r["i"]): r["s"] for r in ordinals.running_totals(df, ["k", "i"], "v", "s").collect()}
    total = 0
    for k, i, v in sorted(values):
        assert got[k, i] == total
        total += v


def test_items_are_neither_sorted_nor_sent_to_one_task(spark, tmp_path):
    path = pages_of(tmp_path, "clusters", "clusters", clusters(50))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = listings.read_clusters(spark, path)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    items = [line for line in plan.splitlines() if "cluster_id" in line]
    assert "BroadcastHashJoin" in plan
    assert not any("Sort " in line or "Exchange" in line for line in items)


def test_first_clusters_straight_from_the_reader(spark, tmp_path):
    items = clusters(30)
    path = pages_of(tmp_path, "clusters", "clusters", items)
    costs = cost.cluster_cost(listings.read_clusters(spark, path), 1_700_000_000, keep=["ord"])
    high = filters.high_usage(costs, n=5, threshold=1000).collect()
    # units: 8 for the driver and 8 for each worker, over 180 hours
    wanted = [c["cluster_id"] for c in items[:5] if 180 * 8 * (1 + c["num_workers"]) > 1000]
    assert [r["cluster_id"] for r in sorted(high, key=lambda r: r["ord"])] == wanted
    tips = cost.tips(costs).orderBy("seq").collect()
    assert [r["tip"].split()[1] for r in tips[: len(wanted)]] == wanted


def test_first_table_straight_from_the_reader(spark, tmp_path):
    items = [
        {"name": f"t{i % 7}", "catalog_name": "c", "schema_name": "s", "comment": str(i)} for i in range(40)
    ]
    path = pages_of(tmp_path, "tables", "tables", items)
    names = spark.createDataFrame([(f"c.s.t{i}",) for i in range(9)], "fq_name STRING")
    found = joins.resolve_tables(names, listings.read_tables(spark, path)).collect()
    assert {r["name"]: r["comment"] for r in found} == {f"t{i}": str(i) for i in range(7)}


def test_last_analysis_straight_from_the_reader(spark, tmp_path):
    items = [{"path": f"/Users/u/n{i % 5}", "object_type": "NOTEBOOK", "object_id": i} for i in range(23)]
    path = pages_of(tmp_path, "assets", "objects", items)
    assets = listings.read_assets(spark, path).withColumn(
        "content", F.concat(F.lit("x = 1\n"), F.expr("repeat('dbutils.fs\n', cast(object_id as int))"))
    ).withColumn("size", F.length("content"))
    analyses = scan.analyze_assets(assets, keep=["ord", "object_id"])
    once = assets.dropDuplicates(["path"]).drop("object_id")
    joined = joins.with_analysis(once, analyses.drop("language")).collect()
    last = {f"/Users/u/n{i % 5}": i for i in range(23)}
    assert {r["path"]: r["object_id"] for r in joined} == last
    report = reports.asset_report(assets, analyses).collect()
    assert len(report) == 23 and {r["risk"] for r in report} == {"red"}
