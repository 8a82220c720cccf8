"""What the plans look like: no cross joins, no row-wise Python, scans cut to their columns."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)
from transhume.operators import cost, joins, rewrite, scan
from transhume.plans import reports
from workload import q_reports, q_scan, views
from workload.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"
PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text
    assert not any(node in text for node in PYTHON_NODES)


NARROW = {
    "scan": lambda s: q_scan.analysis(s, SF_DIR),
    "rewrite": lambda s: q_scan.converted(s, SF_DIR),
    "diff": lambda s: rewrite.line_diff(q_scan.converted(s, SF_DIR)),
    "diff head": lambda s: rewrite.diff_head(q_scan.converted(s, SF_DIR)),
    "overview": lambda s: q_reports.overview(s, SF_DIR),
    "inline report": lambda s: reports.asset_report_inline(views.assets(s, SF_DIR)),
    "tables": lambda s: reports.table_report(views.tables(s, SF_DIR)),
    "jobs": lambda s: reports.job_report(views.jobs(s, SF_DIR)),
}


@pytest.mark.parametrize("name", list(NARROW))
def test_row_wise_work_does_not_shuffle(spark, name):
    assert "Exchange" not in plan(NARROW[name](spark))


def test_scan_is_one_generated_stage(spark):
    text = plan(scan.analyze_assets(views.assets(spark, SF_DIR)))
    nodes = [line for line in text.splitlines() if re.search(r"\bProject \[", line)]
    assert nodes and all("*(1) Project" in line for line in nodes)
    assert len(re.findall(r"regexp_extract_all\(", text)) == 1  # the line count, once


def stored(spark, tmp_path):
    path = f"{tmp_path}/assets"
    views.assets(spark, SF_DIR).write.parquet(path)
    return spark.read.parquet(path)


def read_columns(text):
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<(.*)>", text)]


def test_reports_read_their_columns_only(spark, tmp_path):
    assets = stored(spark, tmp_path)
    facts = assets.select(
        "path", "ord", F.lit("red").alias("risk"), F.lit("simple").alias("complexity"),
        F.lit(0).alias("n_issues"),
    )
    report = reports.asset_report(assets, facts).select("path", "risk")
    for columns in read_columns(plan(report)):
        assert "content" not in columns
    total = cost.storage_cost(views.tables(spark, SF_DIR))
    assert read_columns(plan(total)) == [{"p_partkey", "p_retailprice"}]


def test_no_shuffle_carries_the_content(spark, tmp_path):
    assets = stored(spark, tmp_path)
    analyses = scan.analyze_assets(assets, keep=["ord"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(reports.asset_report(assets, analyses))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text
    # What an exchange carries is the list below it; a column computed from the content may be in it.
    below = [part.splitlines()[1] for part in text.split("Exchange")[1:]]
    assert len(below) == 2
    assert not any(re.search(r"(\[|, )content#\d+(, |\])", line) for line in below)
    assert not any(re.search(r" AS content#\d+", line) for line in below)


def test_bodies_are_read_and_shuffled_once(spark, tmp_path):
    """Of an export that may repeat paths, under the default arguments."""
    stored(spark, tmp_path).select("path", "content").write.parquet(f"{tmp_path}/bodies")
    bodies = spark.read.parquet(f"{tmp_path}/bodies")
    listing = bodies.select("path", F.lit("PYTHON").alias("language"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(joins.with_body(listing, bodies))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # one exchange for the listing, one for the sources, whose aggregate leaves them where the join wants them
    assert text.count("Exchange hashpartitioning") == 2
    assert text.count("content#") and len(re.findall(r"FileScan parquet", text)) == 2


def test_filters_reach_the_scan(spark, tmp_path):
    from transhume.operators import filters
    from transhume.sources import listings

    assets = stored(spark, tmp_path)
    text = plan(filters.facet_filter(listings.scope_assets(assets, "/Users"), language="SQL"))
    pushed = re.search(r"PushedFilters: \[(.*?)\],", text).group(1)
    assert "StringStartsWith(path,/Users/)" in pushed and "EqualTo(language,SQL)" in pushed


def test_selection_shuffles_each_side_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = q_reports.twice(spark, SF_DIR).repartition(4)
        names = q_reports.selected(spark, SF_DIR)
        text = plan(joins.resolve_tables(names, tables))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # one for the tables, one for the names, one to make the names distinct
    assert text.count("Exchange hashpartitioning") == 3


def test_high_usage_never_sorts_everything(spark):
    from transhume.operators import filters

    text = plan(filters.high_usage(q_reports.costs(spark, SF_DIR)))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text
