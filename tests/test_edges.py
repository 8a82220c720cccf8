"""Inputs beside the usual ones: other zones, odd dates, texts that look false, lenient base64, globs."""

import base64
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from transhume.functions import jobs, scalars, types
from transhume.operators import rewrite
from transhume.plans import migration
from transhume.sources import files, listings

TIMES = [
    ("1704067200000", "2024-01-01T00:00:00Z", ""),
    ("1704067200000.0", "2024-01-01T00:00:00Z", ""),
    ("1.7040672e12", "2024-01-01T00:00:00Z", ""),
    ("-5", "1969-12-31T23:59:55Z", ""),
    ("2024-01-05", "2024-01-05T00:00:00Z", "2024-01-05 00:00:00"),
    ("2024-03-10T02:30:00", "2024-03-10T02:30:00Z", "2024-03-10 02:30:00"),
    ("2024-01-05T10:00:00+02:00", "2024-01-05T08:00:00Z", "2024-01-05 08:00:00"),
    ("Jan 5 2024", "2024-01-05T00:00:00Z", "2024-01-05 00:00:00"),
    ("Jan 5, 2024", "2024-01-05T00:00:00Z", "2024-01-05 00:00:00"),
    ("15 January 2024", "2024-01-15T00:00:00Z", "2024-01-15 00:00:00"),
    ("5-Feb-2024", "2024-02-05T00:00:00Z", "2024-02-05 00:00:00"),
    ("2024-01-05 10:00 PM", "2024-01-05T22:00:00Z", "2024-01-05 22:00:00"),
    ("12/31/2023 12:06:07 AM", "2023-12-31T00:06:07Z", "2023-12-31 00:06:07"),
    ("Mon, 15 Jan 2024 12:00:00 GMT", "2024-01-15T12:00:00Z", "2024-01-15 12:00:00"),
    ("Foo 5 2024", "Foo 5 2024", ""),
    ("2024-13-05", "2024-13-05", ""),
    ("99999999999999999", "99999999999999999", ""),
    ("", "", ""),
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_in_any_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(raw,) for raw, _, _ in TIMES], "raw STRING")
        value = F.col("raw")
        rows = df.select(value, scalars.norm_timestamp(value), scalars.display_ts(value)).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [tuple(r) for r in rows] == TIMES


TRUTH = {
    '"0"': True, '"false"': True, '"[]"': True, '""': False, "0": False, "-0.0": False, "0e0": False,
    "0.5": True, "true": True, "false": False, "null": False, "{}": False, "[]": False,
    '{"a":0}': True, "[0]": True,
}


def test_truth_by_kind(spark):
    df = spark.createDataFrame([(j,) for j in TRUTH], "j STRING")
    rows = df.select("j", types.truthy(F.try_parse_json("j"))).collect()
    assert {r[0]: r[1] for r in rows} == TRUTH


def test_job_named_zero(spark):
    df = spark.createDataFrame([('{"name":"0","run_as":"false"}',)], "s STRING")
    settings = jobs.settings_map(F.col("s"))
    nothing = F.lit(None).cast("string")
    row = df.select(
        jobs.job_name(settings, nothing, F.lit(5)), jobs.job_run_as(settings, nothing, nothing)
    ).first()
    assert tuple(row) == ("0", "false")


def lenient(body):
    try:
        return base64.b64decode(body).decode()
    except ValueError:
        return None


def test_base64_as_a_lenient_reader_takes_it(spark):
    rng = random.Random(5)
    bodies = ["".join(rng.choices("QUJDRA==Zm9v-\n", k=rng.randint(0, 14))) for _ in range(3000)]
    bodies += ["QUJD=", "QUJD====", "QUI=QUI=", "QQ=x", "Q", "QU=I"]
    df = spark.createDataFrame([(b,) for b in bodies], "body STRING")
    rows = df.select("body", listings.decoded(F.col("body"))).collect()
    assert [tuple(r) for r in rows] == [(b, lenient(b)) for b in bodies]


def test_base64_is_cleaned_once(spark):
    df = spark.createDataFrame([("YWJj",)], "body STRING").select(
        listings.decoded(F.col("body")).alias("text")
    )
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    for step in ("regexp_replace(", "split("):
        assert plan.count(step) == 1, step


@pytest.mark.parametrize(
    "glob, name, hit",
    [
        ("r_????.json", "r_2024.json", True),
        ("r_????.json", "r_20245.json", False),
        ("a[0-9].x", "a3.x", True),
        ("a[!0-9].x", "a3.x", False),
        ("a.b", "axb", False),
        ("m(1)+*", "m(1)+z", True),
    ],
)
def test_globs(glob, name, hit):
    assert bool(re.fullmatch(files.glob_regex(glob), name)) == hit


def test_share_without_rows_is_not_called_equal(spark):
    a = spark.range(1000).withColumn("v", F.lit(1))
    b = spark.range(1000).withColumn("v", F.lit(2))
    tiny = migration.validate_export(a, b, keys=["id"], pct=1e-7).first()
    assert tiny["count_ok"] and tiny["content_ok"] is None
    assert migration.validate_export(a, b, keys=["id"], pct=5).first()["content_ok"] is False
    assert migration.validate_export(a, a, keys=["id"], pct=0.5).first()["content_ok"] is True
    empty = a.where("id < 0")
    assert migration.validate_export(empty, empty, pct=0.005).first()["content_ok"] is True


def diff_seconds(spark, n):
    source = "display\n(x)\n" * n
    df = spark.createDataFrame([("p", "R", source)], "path STRING, language STRING, content STRING")
    start = time.perf_counter()
    row = rewrite.diff_counts(rewrite.convert_assets(df)).first()
    assert (row["removed"], row["added"]) == (2 * n, n)
    return time.perf_counter() - start


def test_diff_of_matches_over_lines_is_linear(spark):
    diff_seconds(spark, 10)
    small, large = diff_seconds(spark, 10_000), diff_seconds(spark, 100_000)
    assert large < 25 * max(small, 0.4)


def test_mark_only_what_a_rule_matches(spark):
    source = "mydisplay\n(x)\ndisplay\n(y)\n"
    df = spark.createDataFrame([("p", "R", source)], "path STRING, language STRING, content STRING")
    rows = rewrite.line_diff(rewrite.convert_assets(df)).orderBy("seq").collect()
    assert all(r["aligned"] for r in rows)
    assert [(r["op"], r["line"]) for r in rows] == [
        (" ", "mydisplay"), (" ", "(x)"), ("-", "display"), ("-", "(y)"), ("+", "print(y)"),
    ]
