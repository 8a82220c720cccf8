"""Column expressions against plain Python on many random values."""

import base64
import random
import re

from pyspark.sql import functions as F

from transhume import values
from transhume.functions import scalars, text
from transhume.operators import fields, rewrite, scan
from transhume.sources import listings

RANDOM = random.Random(11)
PIECES = [
    "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029",
    "a", "é", " ", "display", "display(", "displayHTML (", "dbutils", "dbutils.fs.ls\n(", "_",
    "dbutils.fs.cp(", "%sql", "spark.", "spark.read", 'spark.read.format( "delta" )',
    "spark.read.format('delta')", "/dbfs/", "dbfs:/", "dbfs:/dbfs/", "DeltaTable", "delta.tables",
    "display\x1c(", "$1", "\\", "x" * 50,
]


def texts(n=600):
    return [""] + ["".join(RANDOM.choices(PIECES, k=RANDOM.randint(1, 14))) for _ in range(n)]


def frame(spark, items):
    rows = [(i, item) for i, item in enumerate(items)]
    return spark.createDataFrame(rows, "i LONG, content STRING").repartition(3, "i")


def column(df, name):
    return [r[name] for r in df.orderBy("i").select(name).collect()]


def test_lines(spark):
    items = texts()
    df = frame(spark, items).withColumn("lines", text.lines(F.col("content")))
    assert column(fields.loc(df), "loc") == [len(t.splitlines()) for t in items]
    assert column(df, "lines") == [t.splitlines() for t in items]
    assert column(fields.newline_count(frame(spark, items)), "lines") == [
        t.count("\n") for t in items
    ]


def test_patterns(spark):
    items = texts()
    found = column(scan.pattern_scan(frame(spark, items)), "detected_patterns")
    wanted = [
        [r.name for r in values.RULES if re.search(r.pattern, t, re.MULTILINE)] for t in items
    ]
    assert found == wanted


def test_literals(spark):
    items = texts()
    found = column(scan.literal_scan(frame(spark, items)), "literals")
    assert found == [[x for x in values.LITERALS if x in t] for t in items]


def test_rewrites(spark):
    items = texts()

    def rewritten(source, bucket):
        for rule in values.REWRITES:
            replacement = rule.replacement.replace("{bucket}", bucket)
            source = re.sub(rule.pattern, lambda _: replacement, source)
        return source

    for bucket in ("lake", "a$1\\b"):
        found = column(rewrite.rewrite(frame(spark, items), bucket=bucket), "content")
        assert found == [rewritten(t, bucket) for t in items]


def test_rounding(spark):
    sizes = [RANDOM.randrange(10 ** RANDOM.randint(1, 13)) for _ in range(3000)]
    sizes += list(range(0, 4096, 8)) + [128 * k for k in range(500)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i LONG, s LONG")
    df = fields.size_units(df, "s")
    assert column(df, "size_kb") == [round(s / 1024, 2) for s in sizes]
    assert column(df, "size_mb") == [round(s / (1024 * 1024), 2) for s in sizes]
    assert column(df, "size_gb") == [s / 1024**3 for s in sizes]


def test_confidence_grid(spark):
    grid = [
        (k, n, s)
        for k in ("simple", "moderate", "medium", "complex", "", None)
        for n in range(9)
        for s in (0.0, 100.0, 100.01, 500.0, 501.0, 2000.0, 2000.5)
    ]

    def wanted(kind, n, size):
        weight = {"simple": 1.0, "moderate": 0.6, "complex": 0.3}.get(kind or "", 0.5)
        factor = 1.0 if size <= 100 else 0.9 if size <= 500 else 0.7 if size <= 2000 else 0.5
        score = weight * (1 - min(n * 0.15, 0.9)) * factor
        return int(round(max(0.0, min(1.0, score)) * 100))

    rows = [(i, *g) for i, g in enumerate(grid)]
    df = spark.createDataFrame(rows, "i LONG, complexity STRING, n_issues INT, size_kb DOUBLE")
    assert column(scan.confidence(df), "confidence_pct") == [wanted(*g) for g in grid]


def test_truncate_and_preview(spark):
    items = ["é" * n for n in (0, 1, 9, 10, 11, 12, 40)]

    def middle(t):
        return t if len(t) <= 10 else t[:6] + "\n\n...TRUNCATED...\n\n" + t[-4:]

    df = frame(spark, items)
    assert column(fields.truncate_middle(df, "content", 10), "content") == [middle(t) for t in items]
    shown = column(fields.preview(df, "content", 10), "preview")
    assert shown == [t[:10] + "..." if len(t) > 10 else t for t in items]


def test_decoding(spark):
    bodies = []
    for t in texts(200):
        body = base64.b64encode(t.encode()).decode()
        bodies += [body, body.rstrip("="), body[:-1], "\n".join(body), "!" + body + " ?", "é" + body]
    bodies += [base64.b64encode(b"\xff\xfe").decode(), "====", "", base64.b64encode(b"\xed\xa0\x80").decode()]

    def wanted(body):
        try:
            return base64.b64decode(re.sub("[^A-Za-z0-9+/=]", "", body)).decode("utf-8") or None
        except Exception:
            return None

    df = frame(spark, bodies)
    kept = {r["i"]: r["content"] for r in listings.decode_content(df).collect()}
    # Padding in the middle is the one case the two decoders may read differently.
    assert {i: kept.get(i) for i in range(len(bodies))} == {
        i: wanted(b) for i, b in enumerate(bodies)
    }


def test_name_parts(spark):
    items = ["/".join(RANDOM.choices(["", "a", "Users", "b.c"], k=4)) for _ in range(100)]
    df = frame(spark, items).withColumnRenamed("content", "path")
    assert column(fields.base_name(df), "name") == [t.split("/")[-1] for t in items]
    found = column(df.withColumn("k", scalars.asset_key(F.col("path"))), "k")
    assert found == ["migrated-notebooks/" + t.lstrip("/") for t in items]
