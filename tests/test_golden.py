"""Small inputs with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from transhume.functions import scalars, types
from transhume.operators import aggregates, cost, fields, filters, joins, rewrite, scan
from transhume.plans import reports

SAMPLE = """\
orders = spark.sql("SELECT o_orderkey, o_totalprice FROM shop.orders")
big = orders.filter("o_totalprice > 1000")
display(big)

for entry in dbutils.fs.ls("dbfs:/incoming/shop"):
    print(entry.path)

target = DeltaTable.forName(spark, "shop.big_orders")
target.alias("t").merge(big.alias("s"), "t.o_orderkey = s.o_orderkey").execute()
dbutils.fs.cp("/dbfs/incoming/a.csv", "/dbfs/done/a.csv")
display(target.toDF())
"""


def asset(spark, content, path="/Users/ann/a", language="PYTHON"):
    return spark.createDataFrame(
        [(path, language, content, len(content))],
        "path STRING, language STRING, content STRING, size LONG",
    )


def test_sample_source(spark):
    rows = scan.analyze_assets(asset(spark, SAMPLE), keep=["size"])
    rows = scan.readiness(rows.withColumn("size_kb", scalars.kilobytes(F.col("size"))))
    row = scan.confidence(rows, n_issues=F.size("issues")).first()
    assert row["detected_patterns"] == ["dbutils", "display", "pyspark", "delta"]
    assert row["loc"] == 11
    assert (row["complexity"], row["risk"]) == ("simple", "red")
    assert len(row["issues"]) == 1 and len(row["suggestions"]) == 2
    assert row["summary"] == "Detected 4 Databricks-specific patterns. Complexity: simple."
    assert (row["confidence_pct"], row["confidence_label"]) == (85, "High")
    assert row["readiness"] == "review"


def test_sample_diff_counts(spark):
    row = rewrite.diff_counts(rewrite.convert_assets(asset(spark, SAMPLE, language="SQL"))).first()
    assert (row["kept"], row["removed"], row["added"], row["header_added"]) == (7, 4, 4, 0)


def test_comment_counts_as_a_hit(spark):
    source = "%sql\nSELECT 1\n\n# dbutils mentioned\nx = 1\n"
    row = scan.analyze_assets(asset(spark, source)).first()
    assert row["detected_patterns"] == ["dbutils", "sql_cell_magic"]
    assert (row["complexity"], row["risk"], len(row["issues"])) == ("simple", "red", 1)


def test_suggestion_without_issue(spark):
    row = scan.analyze_assets(asset(spark, "display(x)")).first()
    assert row["issues"] == [] and len(row["suggestions"]) == 1 and row["risk"] == "green"


def test_analysis_defaults(spark):
    df = spark.createDataFrame(
        [(None, "name", None), ("", None, "x")], "path STRING, name STRING, content STRING"
    )
    rows = {r["path"]: r for r in scan.analyze_assets(df).collect()}
    assert set(rows) == {"name", "<unknown>"}
    assert rows["name"]["loc"] == 0 and rows["name"]["language"] == "python"
    assert rows["name"]["summary"].startswith("Complexity: simple. No obvious")


def test_own_rules(spark):
    from transhume.values import Rule

    rules = [Rule("a", r"\bfoo\b", issue="x"), Rule("b", r"bar$", issue="x")]
    df = asset(spark, "foo\nbar\r\nbar\n")
    row = scan.analyze_assets(df, rules).first()
    assert row["detected_patterns"] == ["a", "b"] and row["issues"] == ["x", "x"]


SIZES = "size_bytes LONG, catalog STRING, schema STRING, name STRING"


def test_sizes_and_storage(spark):
    df = spark.createDataFrame(
        [
            (7340032, "main", "web", "clicks"),
            (102760448, "main", "shop", "line_items"),
            (None, None, None, None),
        ],
        SIZES,
    )
    megabytes = [r["size_mb"] for r in fields.size_units(df, "size_bytes").collect()]
    assert megabytes == [7.0, 98.0, 0.0]
    total = cost.storage_cost(df, 0.023).first()
    assert total["total_bytes"] == 110100480 and total["total_gb"] == 0.1025390625
    assert total["monthly_storage_cost_usd"] == 0.1025390625 * 0.023
    by_catalog = {r["catalog"]: r["size_bytes"] for r in aggregates.storage_by_catalog(df).collect()}
    assert by_catalog == {"main": 110100480, "unknown": 0}
    assert cost.storage_cost(df.where("1 = 0")).first()["total_bytes"] == 0
    classes = {r["storage_class"]: r["monthly_cost_usd"] for r in aggregates.storage_classes(df).collect()}
    assert classes["GLACIER_FR"] == pytest.approx(0.1025390625 * 0.0036) and len(classes) == 4


CLUSTERS = """ord LONG, cluster_id STRING, num_workers INT, autoscale STRUCT<min_workers: INT>,
    driver_node_type_id STRING, node_type_id STRING, start_time LONG, created_time LONG,
    terminated_time LONG, end_time LONG"""


def cluster(spark, *rows):
    return spark.createDataFrame(list(rows), CLUSTERS)


def test_cluster_cost(spark):
    df = cluster(spark, (0, "c", 4, None, None, "i3.xlarge", None, None, None, None))
    row = cost.cluster_cost(df, as_of=1706659200, price=0.40).first()
    assert row["dbu_hours"] == 3600.0 and row["estimated_cost_usd"] == pytest.approx(1440.0)
    assert row["driver_type"] == "i3.xlarge" and row["workers"] == 4
    compute = cost.compute_total(cost.cluster_cost(df, 1706659200, 0.40))
    target = cost.target_cost(compute)
    assert target.first()["compute_cost_usd"] == pytest.approx(231.0516)
    tables = spark.createDataFrame([], SIZES)
    both = cost.compare(compute, target, cost.storage_cost(tables))
    rows = {r["metric"]: r for r in both.collect()}
    assert rows["Total Monthly"]["source_usd"] == pytest.approx(1656.0)
    assert rows["Total Monthly"]["target_usd"] == pytest.approx(265.70934)
    back = cost.roi(both.where("metric = 'Total Monthly'")).first()
    assert back["monthly_savings_usd"] == pytest.approx(1390.29066)
    assert back["annual_savings_usd"] == pytest.approx(16683.48792)
    assert back["migration_cost_estimate_usd"] == pytest.approx(13902.9066)
    assert back["months_to_recover"] == pytest.approx(10)


def test_no_savings(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "source_usd DOUBLE, target_usd DOUBLE")
    row = cost.roi(df).first()
    assert row["migration_cost_estimate_usd"] == 1.0 and row["months_to_recover"] is None


def test_units_and_workers(spark):
    nodes = ["i3.large", "i3.xlarge", "i3.2xlarge", "m5.metal", None, ""]
    df = spark.createDataFrame([(n,) for n in nodes], "n STRING")
    assert [r[0] for r in df.select(cost.node_units(F.col("n"))).collect()] == [8, 4, 4, 4, 4, 4]
    df = spark.createDataFrame([(4, None), (0, 2), (None, None), (-3, 2)], "a INT, b INT")
    workers = df.select(cost.worker_count(F.col("a"), F.col("b")))
    assert [r[0] for r in workers.collect()] == [4, 2, 0, 0]


def test_active_hours(spark):
    as_of, day = 1706659200, 86400
    rows = [
        (None, None),
        (as_of - 10 * day, None),
        ((as_of - 10 * day) * 1000, None),
        ((as_of - 90 * day) * 1000, (as_of - day) * 1000),
        (as_of - 90 * day, (as_of - day) * 1000),
        ((as_of - 50 * day) * 1000, (as_of - 40 * day) * 1000),
    ]
    df = spark.createDataFrame(rows, "a LONG, b LONG")
    args = (F.col("a"), F.col("b"), as_of)
    hours = [r[0] for r in df.select(cost.active_hours(*args)).collect()]
    assert hours == [180.0, 240.0, 240.0, 29 * 24.0, 29 * 24.0, 0.0]
    old = [r[0] for r in df.select(cost.active_hours(*args, compat_clamp=True)).collect()]
    assert old == [180.0, 240.0, 240.0, 89 * 24.0, 29 * 24.0, 240.0]


def test_high_usage_limits_first(spark):
    rows = [
        (i, f"c{i}", 10 * (i % 2 + i // 5), None, None, "i3.xlarge", None, None, None, None)
        for i in range(8)
    ]
    costs = cost.cluster_cost(cluster(spark, *reversed(rows)), 1706659200, keep=["ord"])
    assert [r["cluster_id"] for r in filters.high_usage(costs).collect()] == ["c1", "c3"]
    tips = cost.tips(costs).orderBy("seq").collect()
    assert [t["tip"][:10] for t in tips] == ["Cluster c1", "Cluster c3", "Consider u", "Archive in"]


TIMES = [
    ("1704067200000", "2024-01-01T00:00:00Z"),
    ("1704067200", "1970-01-20T17:21:07Z"),
    ("1000000000", "2001-09-09T01:46:40Z"),
    ("2024-01-15T12:00:00Z", "2024-01-15T12:00:00Z"),
    ("2024-01-15 12:00:00+02:00", "2024-01-15T10:00:00Z"),
    ("1/31/2024", "2024-01-31T00:00:00Z"),
    ("garbage", "garbage"),
    ("99999999999999999999999", "99999999999999999999999"),
    ("", ""),
    (None, None),
]


def test_timestamps(spark):
    df = spark.createDataFrame([(a,) for a, _ in TIMES], "t STRING")
    assert [r[0] for r in fields.norm_timestamp(df, "t").collect()] == [b for _, b in TIMES]
    sane = spark.createDataFrame([("1704067200",)], "t STRING")
    assert fields.norm_timestamp(sane, "t", 1e12).first()[0] == "2024-01-01T00:00:00Z"
    number = spark.createDataFrame([(1704067200000,)], "t LONG")
    assert fields.norm_timestamp(number, "t").first()[0] == "2024-01-01T00:00:00Z"


RENDERED = [
    ('{"type":"decimal","precision":10,"scale":2}', "decimal(10,2)"),
    ('{"type":"decimal"}', "decimal"),
    ('{"type":"numeric","precision":5}', "decimal"),
    (
        '{"type":"struct","fields":[{"name":"a","type":"int"},{"name":"b","type":"string"}]}',
        "struct<a:int, b:string>",
    ),
    (
        '{"type":"array","elementType":{"type":"decimal","precision":10,"scale":2}}',
        "array<decimal(10,2)>",
    ),
    ('{"type":"map","keyType":"string","valueType":"int"}', "map"),
    ('{"type":{"type":{"type":"date"}}}', "date"),
    ('{"fields":[{"field":"x","dtype":{"elementType":{"fields":[]}}}]}', "struct<x:array<struct<>>>"),
    ('{"elementType":null}', "array<string>"),
    ("null", "string"),
    ('"varchar(3)"', "varchar(3)"),
    ("7", "7"),
    ("true", "True"),
]


def test_rendered_types(spark):
    df = spark.createDataFrame([(a,) for a, _ in RENDERED], "j STRING")
    df = df.select(F.parse_json("j").alias("t"))
    assert [r[0] for r in fields.render_type(df, "t").collect()] == [b for _, b in RENDERED]


def test_deep_type(spark):
    text, wanted = '"int"', "int"
    for _ in range(types.DEPTH):
        text, wanted = f'{{"type":"array","elementType":{text}}}', f"array<{wanted}>"
    df = spark.createDataFrame([(text,)], "j STRING").select(F.parse_json("j").alias("t"))
    assert fields.render_type(df, "t").first()[0] == wanted


def test_column_entries(spark):
    entries = """[{"name":"a","type":"int","nullable":false}, "b  decimal(1, 2)  x", "c",
        {"column_name":"d","type":null,"data_type":"date","is_nullable":0},
        {"name":"","field":"e","schema":{"type":"decimal"}},
        {"col_name":"f","type":{"type":"int","nullable":false}},
        {"name":"g","nullable":null}, "", "  ", null]"""
    df = spark.createDataFrame([(entries,)], "j STRING")
    df = df.selectExpr("cast(parse_json(j) AS ARRAY<VARIANT>) AS columns")
    found = [tuple(c) for c in fields.normalize_columns(df).first()["columns"]]
    assert found == [
        ("a", "int", False),
        ("b", "decimal(1, 2) x", True),
        ("c", "string", True),
        ("d", "date", False),
        ("e", "decimal", True),
        ("f", "int", False),
        ("g", "string", False),
        ("None", "string", True),
    ]


def test_confidence(spark):
    df = spark.createDataFrame(
        [("medium", 0, 10.0), ("complex", 1, 3000.0), ("simple", 7, 1.0), (None, None, None)],
        "complexity STRING, n_issues INT, size_kb DOUBLE",
    )
    rows = [(r["confidence_pct"], r["confidence_label"]) for r in scan.confidence(df).collect()]
    assert rows == [(50, "Medium"), (13, "Low"), (10, "Low"), (50, "Medium")]


REPLIES = [
    ('{"complexity_score": 7, "risk": "low"}', (7, "low", 8.0, None)),
    ('{"result": {"complexity": "4", "effort_hours": "2.5"}}', (4, "medium", 2.5, None)),
    ('{"body": "{\\"complexity_score\\": 9.7}"}', (9, "medium", 8.0, None)),
    ('{"complexity_score": 0, "complexity": 5}', (5, "medium", 8.0, None)),
    ('{"complexity_score": "x"}', (3, "medium", 8.0, '{"complexity_score": "x"}')),
    ('{"output": "no json"}', (3, "medium", 8.0, '{"output": "no json"}')),
    ('{"output": 5, "risk_assessment": "high"}', (3, "high", 8.0, None)),
    ("[1]", (3, "medium", 8.0, "[1]")),
    ("text", (3, "medium", 8.0, "text")),
]


def test_replies(spark):
    df = spark.createDataFrame([(a,) for a, _ in REPLIES], "raw STRING")
    rows = fields.parse_reply(df).collect()
    names = ("complexity_score", "risk_assessment", "estimated_effort_hours", "raw_response_preview")
    assert [tuple(r[n] for n in names) for r in rows] == [b for _, b in REPLIES]


def test_jobs(spark):
    rows = [
        (1, None, '{"notebook_task": {"p": 1}, "schedule": {"cron": "x"}}', False),
        (2, "n", "{}", True),
        (None, "n", '{"email_notifications": null, "dbt_task": {}}', True),
        (4, "", '{"FILE_ARRIVAL_NOTIFICATION": 1, "run_as": {"u": 1}}', None),
    ]
    df = spark.createDataFrame(
        rows, "job_id LONG, name STRING, settings STRING, is_paused BOOLEAN"
    ).withColumns({"id": F.lit(9), "creator_user_name": F.lit(""), "created_by": F.lit("by")})
    found = [tuple(r) for r in reports.job_report(df).collect()]
    assert found == [
        (1, "job_1", "notebook", "by", "scheduled"),
        (2, "n", "unknown", "by", "ad-hoc"),
        (9, "n", "other", "by", "paused"),
        (4, "job_4", "other", '{"u":1}', "file-arrival"),
    ]


def test_names(spark):
    df = spark.createDataFrame([("a.b.c.d",), ("a.b",), ("a",), ("",)], "fq_name STRING")
    found = [tuple(r)[1:] for r in fields.parse_fq(df).collect()]
    assert found == [("a", "b", "c.d"), ("a", "b", ""), ("", "", "a"), ("", "", "")]
    paths = ["/Users/bob/x", "/Shared/x", "/x", "/", "", None, "Users"]
    df = spark.createDataFrame([(p,) for p in paths], "path STRING")
    owners = [r["owner"] for r in fields.owner_from_path(df).collect()]
    assert owners == ["bob", "Shared", "x", "", "unknown", "unknown", "Users"]
    df = spark.createDataFrame([("//a/b",)], "path STRING")
    assert fields.dest_key(df, "s3://x/").first()["dest_key"] == "s3://x/migrated-notebooks/a/b"


def test_filters(spark):
    df = spark.createDataFrame(
        [("A.b", "x", None), ("c", "A.B", "o")], "path STRING, name STRING, owner STRING"
    )
    assert filters.search(df, "a.b").count() == 2
    assert filters.search(df, "a.b", cols=["path"], regex=True).count() == 1
    assert filters.search(df, "").count() == 2
    assert filters.facet_filter(df, path="All", name=None).count() == 2
    assert filters.cascade_filter(
        spark.createDataFrame([("c", "s")], "catalog STRING, schema STRING"), "c", "t"
    ).count() == 0


def test_risk_classes_at_zero(spark):
    df = spark.createDataFrame([("red",), (None,), ("odd",)], "risk STRING")
    found = {r["risk"]: r["n"] for r in aggregates.risk_counts(df).collect()}
    assert found == {"red": 1, "green": 1, "yellow": 0, "odd": 1}


def test_joins_pick_first_and_last(spark):
    assets = spark.createDataFrame([("p",), ("q",)], "path STRING")
    runs = spark.createDataFrame(
        [("p", 2, "red"), ("p", 9, "green"), ("p", 5, "yellow"), ("", 1, "red")],
        "path STRING, ord LONG, risk STRING",
    )
    found = {r["path"]: r["risk"] for r in joins.with_analysis(assets, runs).collect()}
    assert found == {"p": "green", "q": "unknown"}
    tables = spark.createDataFrame(
        [(2, "c", "s", "n.m"), (1, "c", "s", "n.m"), (0, "c", "s", "n")],
        "ord LONG, catalog STRING, schema STRING, name STRING",
    )
    names = spark.createDataFrame([("c.s.n.m",), ("c.s.none",)], "fq_name STRING")
    assert [r["ord"] for r in joins.resolve_tables(names, tables).collect()] == [1]
    assert [r[0] for r in joins.missing_tables(names, tables).collect()] == ["c.s.none"]


def test_review_list_is_the_rest(spark):
    df = spark.createDataFrame(
        [("simple", ""), ("simple", "x"), ("complex", ""), (None, ""), ("simple", None)],
        "complexity STRING, issues STRING",
    )
    assert joins.auto_list(df).count() == 1 and joins.review_list(df).count() == 4


def test_prices_fall_back(spark):
    prices = spark.createDataFrame([("a", 1.5)], "key STRING, value DOUBLE")
    row = joins.with_prices(spark.range(1), prices, {"a": 9.0, "b": 7.0}).first()
    assert (row["a"], row["b"]) == (1.5, 7.0)
