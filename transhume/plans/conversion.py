"""Conversion of a set of sources: rewritten, written at their keys, and reported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transhume.operators import rewrite
from transhume.session import scratch_dir
from transhume.sinks.reports import write_conversion_report, write_converted
from transhume.sources import listings


def convert_batch(
    spark: SparkSession,
    assets: DataFrame,
    root: str,
    bucket: str | None = None,
    report: str | None = None,
) -> DataFrame:
    """Convert and write every source; gives (converted_key, uploaded, error) rows.

    The files are written once, by the job that logs their status; rows and report read the log.
    """
    log = scratch_dir(spark, "conversion-status")
    converted = rewrite.convert_assets(assets, bucket)
    write_converted(converted, root).write.parquet(log)
    status = spark.read.parquet(log).groupBy(F.col("key").alias("converted_key"))
    status = status.agg(F.bool_and("ok").alias("uploaded"), F.max("error").alias("error"))
    if report:
        write_conversion_report(converted.join(status, "converted_key"), report)
    return status


def convert_with_errors(
    df: DataFrame, bucket: str | None = None, body: str = "content"
) -> DataFrame:
    """Conversion of base64 bodies; an unreadable one gives a row with ``error`` set."""
    unread = F.lit("source is not base64-encoded UTF-8 text")
    source = df.withColumn("content", listings.decoded(F.col(body)))
    source = source.withColumn("error", F.when(F.col("content").isNull(), unread))
    converted = rewrite.convert_assets(source, bucket, keep=["error"])
    failed = F.col("error").isNotNull()
    return converted.withColumns(
        {
            name: F.when(~failed, F.col(name))
            for name in ("converted_key", "before", "header", "body", "after")
        }
    )
