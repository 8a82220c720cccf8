"""Scan, rewrite and diff queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transhume import values
from transhume.functions import scalars
from transhume.operators import rewrite, scan
from transhume.plans import conversion
from transhume.session import scratch_dir
from transhume.sinks import objects
from workload import views
from workload.registry import query
from workload.views import ASSETS, SCAN, confidence_sql, with_

ANALYSIS = with_(ASSETS, SCAN)


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.analyze_assets(views.assets(spark, sf_dir), keep=["ord", "size", "owner"])


@query("scan_patterns", ANALYSIS + "SELECT path, detected FROM scan")
def scan_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan.pattern_scan(views.assets(spark, sf_dir))
    return rows.select("path", F.array_join("detected_patterns", "|").alias("detected"))


@query("scan_complexity", ANALYSIS + "SELECT path, complexity FROM scan")
def scan_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).select("path", "complexity")


@query("scan_issues", ANALYSIS + "SELECT path, issues FROM scan")
def scan_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan.rule_messages(scan.pattern_scan(views.assets(spark, sf_dir)), kind="issue")
    return rows.select("path", F.array_join("issues", ", ").alias("issues"))


@query("scan_suggestions", ANALYSIS + "SELECT path, suggestions FROM scan")
def scan_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan.rule_messages(scan.pattern_scan(views.assets(spark, sf_dir)), kind="suggestion")
    return rows.select("path", F.array_join("suggestions", ", ").alias("suggestions"))


@query("scan_risk", ANALYSIS + "SELECT path, risk FROM analysis")
def scan_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).select("path", "risk")


@query("scan_summary", ANALYSIS + "SELECT path, summary FROM analysis")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).select("path", "summary")


@query(
    "analyze_assets",
    ANALYSIS
    + """SELECT path, language, complexity, issues, suggestions, detected, risk, summary, loc
    FROM analysis""",
)
def analyze_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan.analyze_assets(views.assets(spark, sf_dir))
    return rows.select(
        "path",
        "language",
        "complexity",
        F.array_join("issues", ", ").alias("issues"),
        F.array_join("suggestions", ", ").alias("suggestions"),
        F.array_join("detected_patterns", "|").alias("detected"),
        "risk",
        "summary",
        "loc",
    )


# Besides the real sizes, a spread of sizes and issue counts so that every branch is met.
PCT, LABEL = confidence_sql("complexity", "n_issues", "size_kb")
WIDE_PCT, WIDE_LABEL = confidence_sql("kind", "(ord % 9)", "(size_kb * (ord % 997))")


@query(
    "score_confidence",
    ANALYSIS
    + f"""SELECT path, {PCT} AS confidence_pct, {LABEL} AS confidence_label,
      {WIDE_PCT} AS wide_pct, {WIDE_LABEL} AS wide_label
    FROM (SELECT *, CASE ord % 4 WHEN 0 THEN 'simple' WHEN 1 THEN 'moderate'
      WHEN 2 THEN 'complex' ELSE 'medium' END AS kind FROM analysis)""",
)
def score_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analysis(spark, sf_dir).withColumn("size_kb", scalars.kilobytes(F.col("size")))
    rows = scan.confidence(rows, n_issues=F.size("issues"))
    rows = rows.select(
        "path",
        F.col("confidence_pct").alias("pct"),
        F.col("confidence_label").alias("label"),
        views.case(
            "ord % 4", n0="'simple'", n1="'Moderate'", n2="'complex'", n3="'medium'"
        ).alias("kind"),
        (F.col("ord") % 9).alias("n"),
        (F.col("size_kb") * (F.col("ord") % 997)).alias("kb"),
    )
    return scan.confidence(rows, "kind", "n", "kb").select(
        "path",
        F.col("pct").alias("confidence_pct"),
        F.col("label").alias("confidence_label"),
        F.col("confidence_pct").alias("wide_pct"),
        F.col("confidence_label").alias("wide_label"),
    )


@query(
    "score_readiness",
    ANALYSIS
    + """SELECT path, CASE WHEN complexity = 'simple' AND n_issues = 0 THEN 'auto' ELSE 'review' END
      AS readiness FROM analysis""",
)
def score_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.readiness(analysis(spark, sf_dir)).select("path", "readiness")


LITERAL_SQL = ", ".join(
    f"CASE WHEN contains(content, '{lit}') THEN '{lit}' END" for lit in values.LITERALS
)


@query(
    "scan_literals",
    with_(ASSETS) + f"SELECT path, concat_ws('|', {LITERAL_SQL}) AS literals FROM assets_v",
)
def scan_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan.literal_scan(views.assets(spark, sf_dir))
    return rows.select("path", F.array_join("literals", "|").alias("literals"))


# Rewrite ---------------------------------------------------------------------------------------

REWRITTEN = "content"
for pattern, text in (
    (r"\bdisplay\s*\(", "print("),
    (r"\bdisplayHTML\s*\(", "print("),
    (r"dbutils\.fs\.ls\s*\(", "s3_list("),
    (r"dbutils\.fs\.cp\s*\(", "s3_copy("),
    (r"spark\.read\.format\(\s*\"delta\"\s*\)", 'spark.read.format("parquet")'),
    ("/dbfs/", "s3://{bucket}/"),
    ("dbfs:/", "s3://{bucket}/"),
):
    REWRITTEN = f"regexp_replace({REWRITTEN}, '{pattern}', '{text}', 'g')"

BUCKET = "lake$1"  # a bucket name with a character that is special in replacements


def headed(language: str, body: str) -> str:
    def literal(text: str) -> str:
        return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    return f"""CASE {language} WHEN 'PYTHON' THEN {literal(values.PYTHON_HEADER)} || chr(10)
      WHEN 'SCALA' THEN {literal(values.SCALA_HEADER)} || chr(10) ELSE '' END || {body}"""


CONVERTED = f"""converted AS (
SELECT path, 'migrated-notebooks/' || ltrim(path, '/') AS converted_key, language,
  content AS before, {REWRITTEN.replace("{bucket}", BUCKET)} AS body
FROM assets_v),
full_converted AS (SELECT *, {headed("language", "body")} AS after FROM converted)"""


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.convert_assets(views.assets(spark, sf_dir), BUCKET)


@query("conv_rewrite", with_(ASSETS, CONVERTED) + "SELECT path, body AS content FROM converted")
def conv_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.rewrite(views.assets(spark, sf_dir), bucket=BUCKET).select("path", "content")


@query(
    "conv_header",
    with_(ASSETS) + f"SELECT path, {headed('language', 'content')} AS content FROM assets_v",
)
def conv_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.inject_header(views.assets(spark, sf_dir)).select("path", "content")


@query(
    "conv_assets",
    with_(ASSETS, CONVERTED)
    + "SELECT path, converted_key, language, before, after FROM full_converted",
)
def conv_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return converted(spark, sf_dir).select("path", "converted_key", "language", "before", "after")


# Lines by position; no asset of the view changes its line count, and none has other line ends.
def numbered(name: str, col: str) -> str:
    body = f"regexp_replace({col}, '\\n$', '')"
    return f"""{name} AS (SELECT path, unnest(string_split({body}, chr(10))) AS line,
      generate_subscripts(string_split({body}, chr(10)), 1) AS pos FROM full_converted)"""


DIFF = f"""{numbered("b", "before")},
{numbered("a", "body")},
h AS (SELECT path, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM (
  SELECT path, string_split(regexp_replace(left(after, length(after) - length(body)), '\\n$', ''),
    chr(10)) AS lines FROM full_converted WHERE length(after) > length(body))),
both_sides AS (
  SELECT path, pos, b.line AS l, a.line AS r FROM b FULL JOIN a USING (path, pos)),
anchored AS (
  SELECT *, coalesce(max(CASE WHEN l = r THEN pos END) OVER (
    PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS anchor FROM both_sides),
ops AS (
  SELECT path, -1 AS anchor, pos, '+' AS op, line, 0 AS sub FROM h
  UNION ALL SELECT path, anchor, pos, ' ', l, 0 FROM anchored WHERE l = r
  UNION ALL SELECT path, anchor, pos, '-', l, 1 FROM anchored
    WHERE l IS DISTINCT FROM r AND l IS NOT NULL
  UNION ALL SELECT path, anchor, pos, '+', r, 2 FROM anchored
    WHERE l IS DISTINCT FROM r AND r IS NOT NULL),
diff AS (
  SELECT path,
    CAST(row_number() OVER (PARTITION BY path ORDER BY anchor, sub, pos) - 1 AS INTEGER) AS seq,
    op, line FROM ops)"""


@query(
    "conv_diff",
    with_(ASSETS, CONVERTED, DIFF) + "SELECT path, seq, op, line, true AS aligned FROM diff",
)
def conv_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.line_diff(converted(spark, sf_dir))


@query(
    "conv_diff_counts",
    with_(ASSETS, CONVERTED, DIFF)
    + """SELECT path, sum(least(nb, na))::BIGINT AS kept, sum(nb - least(nb, na))::BIGINT AS removed,
      sum(na - least(nb, na))::BIGINT AS added,
      coalesce((SELECT count(*) FROM h WHERE h.path = t.path), 0)::BIGINT AS header_added
    FROM (SELECT path, line, count(*) FILTER (side = 0) AS nb, count(*) FILTER (side = 1) AS na
      FROM (SELECT path, line, 0 AS side FROM b UNION ALL SELECT path, line, 1 FROM a)
      GROUP BY path, line) t GROUP BY path""",
)
def conv_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.diff_counts(converted(spark, sf_dir))


@query(
    "conv_diff_head",
    with_(ASSETS, CONVERTED, DIFF) + "SELECT path, seq, op, line FROM diff WHERE seq < 200",
)
def conv_diff_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.diff_head(converted(spark, sf_dir))


@query(
    "conv_tally",
    with_(ASSETS, CONVERTED)
    + """SELECT converted_key, md5(after) AS written_md5, count(*) OVER () AS n_uploaded,
      count(*) OVER () AS n_total FROM full_converted""",
)
def conv_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tally beside every converted source as it was written, a file each."""
    root = scratch_dir(spark, "converted")
    status = conversion.convert_batch(spark, views.assets(spark, sf_dir), root, BUCKET)
    texts = objects.get_texts(status.where("uploaded"), root, key="converted_key")
    written = views.kept(texts, "texts")
    tally = rewrite.conversion_tally(status)
    found = written.select(
        F.col("key").alias("converted_key"), F.md5(F.col("text").cast("binary")).alias("written_md5")
    )
    return found.withColumns({name: tally.select(name).scalar() for name in ("n_uploaded", "n_total")})
