"""Analysis by distinct content: a source is scanned once for each version of the rules.

Results are stored by content hash in a folder named after the rule version, so other rules or size bounds start
a store of their own and old results stay valid.  A run hashes the sources, finds by an anti join of hashes alone
which contents have no result yet, scans these, adds their results and joins all sources with the store.  Sources
travel only where Spark has to shuffle them to find the new ones: few new hashes are broadcast, and a store
without results needs no join.  A run that fails adds nothing, and one that runs twice adds rows of the same
meaning, of which one is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transhume import values
from transhume.functions import scalars
from transhume.operators import scan
from transhume.operators.fields import existing
from transhume.session import scratch_dir
from transhume.values import Rule

HASH = "_content_hash"  # must not be a column of the assets
RESULT = (
    "_content_hash STRING, detected_patterns ARRAY<STRING>, loc INT, complexity STRING, "
    "issues ARRAY<STRING>, suggestions ARRAY<STRING>, risk STRING, summary STRING"
)


def rule_version(rules: Sequence[Rule] = values.RULES, bounds: tuple[int, int] = values.SIZE_BOUNDS) -> str:
    """Names what a result depends on besides the content: the rules with their messages, and the size bounds."""
    described = repr([tuple(vars(rule).items()) for rule in rules]) + repr(tuple(bounds))
    described += values.SUMMARY_SOME + values.SUMMARY_NONE
    return hashlib.sha256(described.encode("utf-8")).hexdigest()[:24]


def read_results(spark: SparkSession, store: str, version: str) -> DataFrame:
    """One row for each content with a result; none where the store is new."""
    path = f"{store.rstrip('/')}/rules={version}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(path).dropDuplicates([HASH])


def hashed(df: DataFrame) -> DataFrame:
    """The rows with the SHA-256 of their content; a null content is an empty one."""
    return df.withColumn(HASH, F.sha2(F.encode(F.coalesce("content", F.lit("")), "utf-8"), 256))


def add_results(
    assets: DataFrame,
    store: str,
    rules: Sequence[Rule] = values.RULES,
    bounds: tuple[int, int] = values.SIZE_BOUNDS,
) -> int:
    """Scan the contents that have no result for these rules and store theirs; gives their number.

    Rows that share a new content are scanned each, as a scan costs less than moving the text to one of them, and
    one result is stored.
    """
    spark, version = assets.sparkSession, rule_version(rules, bounds)
    known = read_results(spark, store, version)
    rows = hashed(assets.select(F.lit("").alias("path"), "content"))
    fresh = scratch_dir(spark, "fresh-contents")
    rows.select(HASH).distinct().join(known.select(HASH), HASH, "left_anti").write.parquet(fresh)
    new = spark.read.schema(f"{HASH} STRING").parquet(fresh)
    n_new = new.count()
    if not n_new:
        return 0
    if not known.isEmpty():
        rows = rows.join(new, HASH, "left_semi")
    results = scan.analyze_assets(rows, rules, bounds, keep=[HASH]).drop("path", "language")
    results = results.dropDuplicates([HASH]).select(*spark.createDataFrame([], RESULT).columns)
    results.write.mode("append").parquet(f"{store.rstrip('/')}/rules={version}")
    return n_new


def analyze(
    assets: DataFrame,
    store: str,
    rules: Sequence[Rule] = values.RULES,
    bounds: tuple[int, int] = values.SIZE_BOUNDS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The rows of ``scan.analyze_assets``; only contents new to the store are scanned.

    Every row of the assets has one, also where rows repeat.  No assets give no rows and an unchanged store.
    """
    add_results(assets, store, rules, bounds)
    results = read_results(assets.sparkSession, store, rule_version(rules, bounds))
    path = scalars.first_set(existing(assets, "path", "object_path", "name"), "")
    language = existing(assets, "language") or [F.lit(None)]
    kept = [name for name in keep if name not in ("path", "language", HASH)]
    rows = hashed(assets).select(
        F.coalesce(path, F.lit("<unknown>")).alias("path"),
        F.coalesce(*language, F.lit("python")).alias("language"),
        *kept,
        HASH,
    )
    return rows.join(results, HASH, "left").select(
        "path", "language", *kept, *[name for name in results.columns if name != HASH]
    )
