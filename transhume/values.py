"""Rule tables, messages, prices and defaults, all as data.

Every operator takes these as arguments; the tables below are only the defaults.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """A named pattern with the messages it leads to.

    ``hints`` are literals of which at least one occurs in every match.  They let a cheap byte
    search skip the regular expression on the texts that cannot match (usually nearly all).
    """

    name: str
    pattern: str
    hints: tuple[str, ...] = ()
    issue: str | None = None
    suggestion: str | None = None


@dataclass(frozen=True)
class Rewrite:
    """A pattern and its replacement text; ``{bucket}`` in the text is filled in."""

    pattern: str
    replacement: str
    hints: tuple[str, ...] = ()


# Scan patterns and their messages. -----------------------------------------------
RULES = (
    Rule(
        "dbutils",
        r"\bdbutils\b",
        hints=("dbutils",),
        issue="Uses dbutils - these utilities are Databricks-specific.",
        suggestion="Replace dbutils calls with boto3 or AWS equivalents.",
    ),
    Rule(
        "display",
        r"\bdisplay\b",
        hints=("display",),
        suggestion="Uses display() - consider rendering in alternative AWS tooling.",
    ),
    Rule("displayHTML", r"\bdisplayHTML\b", hints=("displayHTML",)),
    Rule("sql_cell_magic", r"^%sql", hints=("%sql",)),
    Rule("pyspark", r"\bspark\.(read|sql|createDataFrame)\b", hints=("spark.",)),
    Rule(
        "delta",
        r"\bdelta\.tables\b|\bDeltaTable\b",
        hints=("delta.tables", "DeltaTable"),
    ),
)

# Literals of the plain substring scan.
LITERALS = (
    "dbutils",
    "display(",
    "%magic",
    "spark.databricks",
    "DeltaTable",
    "mlflow.databricks",
)

# Ordered rewrites; each one sees the output of the one before.
REWRITES = (
    Rewrite(r"\bdisplay\s*\(", "print(", hints=("display",)),
    Rewrite(r"\bdisplayHTML\s*\(", "print(", hints=("displayHTML",)),
    Rewrite(r"dbutils\.fs\.ls\s*\(", "s3_list(", hints=("dbutils.fs.ls",)),
    Rewrite(r"dbutils\.fs\.cp\s*\(", "s3_copy(", hints=("dbutils.fs.cp",)),
    Rewrite(
        r"spark\.read\.format\(\s*\"delta\"\s*\)",
        'spark.read.format("parquet")',
        hints=("spark.read.format(",),
    ),
    Rewrite(r"/dbfs/", "s3://{bucket}/", hints=("/dbfs/",)),
    Rewrite(r"dbfs:/", "s3://{bucket}/", hints=("dbfs:/",)),
)

# Size class bounds, confidence tables, thresholds.
SIZE_BOUNDS = (100, 500)  # lines: below the first simple, below the second medium, else complex
COMPLEXITY_WEIGHT = {"simple": 1.0, "moderate": 0.6, "complex": 0.3}
OTHER_WEIGHT = 0.5
ISSUE_PENALTY = 0.15
MAX_PENALTY = 0.9
SIZE_FACTORS = ((100, 1.0), (500, 0.9), (2000, 0.7))  # size in KB up to -> factor
OVERSIZE_FACTOR = 0.5
CONFIDENCE_LABELS = ((80, "High"), (50, "Medium"))  # percent from -> label
LOWEST_LABEL = "Low"
RISKS = ("green", "yellow", "red")

# Texts.
SUMMARY_SOME = "Detected %d Databricks-specific patterns. Complexity: %s."
SUMMARY_NONE = "Complexity: %s. No obvious Databricks-specific patterns detected."
CLUSTER_TIP = "Cluster %s has high usage; consider profiling and right-sizing."
TRUNCATE_LIMIT = 8000
TRUNCATE_MARKER = "\n\n...TRUNCATED...\n\n"
REPLY_WRAPPERS = ("result", "output", "body", "Response", "content")
DEFAULT_BUCKET = "migrated-bucket"
TABLES_PREFIX = "migrated-tables"
ASSETS_PREFIX = "migrated-notebooks"
UNNAMED_ASSET = "unnamed.py"
TIPS = (
    "Consider using spot instances or EMR Managed Scaling for cost savings.",
    "Archive infrequently accessed data to Glacier/IA to reduce S3 costs.",
)

# Cost defaults.
UNIT_PRICE = 0.55
STORAGE_PRICE = 0.023
VCPU_PRICE = 0.052624
MEMORY_PRICE = 0.0057785
BUFFER = 0.15
LOOKBACK_DAYS = 30
UTILIZATION = 0.25
TARGET_MODEL = "emr_serverless_estimate"
STORAGE_CLASS_PRICES = {
    "STANDARD": 0.023,
    "STANDARD_IA": 0.0125,
    "GLACIER_IR": 0.004,
    "GLACIER_FR": 0.0036,
}
# -----------------------------------------------------------------------------------------------

PROMPT = (
    "Review the source below for a platform move.\n"
    "Path: {path}\n"
    "Give a short summary, the blockers, and the approach you suggest.\n"
    "Source:\n"
)

# Definitions the rewritten calls need, put in front of converted sources.
PYTHON_HEADER = '''
# object store helpers for converted code
import boto3

_store = boto3.resource("s3")


def _bucket_and_key(uri):
    bucket, _, key = uri.removeprefix("s3://").partition("/")
    return bucket, key


def s3_list(uri):
    bucket, prefix = _bucket_and_key(uri)
    return [item.key for item in _store.Bucket(bucket).objects.filter(Prefix=prefix)]


def s3_copy(source, target):
    bucket, key = _bucket_and_key(source)
    to_bucket, to_key = _bucket_and_key(target)
    _store.Bucket(to_bucket).copy({"Bucket": bucket, "Key": key}, to_key)
    return True
'''
SCALA_HEADER = "\n// converted code: read and write through s3a paths\n"
HEADERS = {"PYTHON": PYTHON_HEADER, "PY": PYTHON_HEADER, "SCALA": SCALA_HEADER}
