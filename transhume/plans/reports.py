"""The four list reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transhume.functions import scalars
from transhume.operators import fields, joins, scan

# Where the time shown for an asset is looked for, in this order.
SHOWN_TIME = ("modified_at", "updated_at", "modified", "last_modified")


def overview(analyses: DataFrame) -> DataFrame:
    """Analysed assets as a flat list; wants ``size`` and ``owner`` kept by the analysis."""
    sized = analyses.withColumn("size_kb", scalars.kilobytes(F.col("size")))
    owner = scalars.first_set(fields.existing(sized, "owner", "username"), "")
    flat = fields.base_name(sized.withColumn("owner", F.coalesce(owner, F.lit(""))))
    flat = scan.confidence(flat, n_issues=F.size("issues"))
    return fields.join_lists(flat, ["issues", "suggestions"]).select(
        "path",
        "name",
        "owner",
        "complexity",
        "risk",
        "issues",
        "suggestions",
        "size_kb",
        "confidence_pct",
        "confidence_label",
    )


def shown_name(rows: DataFrame) -> DataFrame:
    path = scalars.unless(F.col("path"), "")
    named = fields.base_name(rows)
    return named.withColumn("name", F.when(path.isNull(), "Unknown").otherwise(F.col("name")))


def report_fields(assets: DataFrame) -> DataFrame:
    """What the report takes from an asset itself.  Here the content ends: no join carries it."""
    shown = scalars.first_set(fields.existing(assets, *SHOWN_TIME), "")
    rows = assets.withColumns(
        {
            "_shown": shown,
            "size_kb": scalars.kilobytes(F.col("size")),
            "language": F.coalesce("language", F.lit("Unknown")),
        }
    )
    rows = fields.newline_count(fields.owner_from_path(rows), "content")
    rows = fields.display_ts(shown_name(rows), "_shown")
    return rows.select("path", "name", "language", "owner", "last_modified", "size_kb", "lines")


def asset_report(assets: DataFrame, analyses: DataFrame, order: str = "ord") -> DataFrame:
    """Assets with risk, enrichment status and confidence from their last analysis.

    Both sides are cut to a few short columns before the join.
    """
    facts = analyses.select(
        "path",
        order,
        "risk",
        "complexity",
        *fields.existing(analyses, "n_issues"),
        *[F.size(c).alias("n_issues") for c in fields.existing(analyses, "issues")],
        *fields.existing(analyses, "enrichment"),
    )
    joined = joins.with_analysis(report_fields(assets), facts, order)
    if "enrichment" in joined.columns:
        joined = fields.enrichment_status(joined)
    else:
        joined = joined.withColumn("status", F.lit("Not enabled"))
    return scan.confidence(joined).drop("complexity", "n_issues", "enrichment")


def asset_report_inline(assets: DataFrame) -> DataFrame:
    """The same report straight from the sources: scan and report in one pass, no shuffle.

    Right wherever each path occurs once, which an export guarantees.
    """
    scanned = scan.analyze_assets(assets, keep=assets.columns)
    facts: dict[str, Column] = {"n_issues": F.size("issues"), "status": F.lit("Not enabled")}
    scanned = scanned.withColumns(facts)
    shown = scalars.first_set(fields.existing(scanned, *SHOWN_TIME), "")
    rows = scanned.withColumns({"_shown": shown, "size_kb": scalars.kilobytes(F.col("size"))})
    rows = fields.newline_count(fields.owner_from_path(rows), "content")
    rows = scan.confidence(fields.display_ts(shown_name(rows), "_shown"))
    return rows.select(
        "path",
        "name",
        "language",
        "owner",
        "last_modified",
        "size_kb",
        "lines",
        "risk",
        "status",
        "confidence_pct",
        "confidence_label",
    )


def table_report(tables: DataFrame) -> DataFrame:
    location = scalars.first_set(fields.existing(tables, "storage_location", "location"), "")
    return fields.column_count(tables).select(
        F.coalesce("name", F.lit("Unknown")).alias("name"),
        F.coalesce("catalog", F.lit("Unknown")).alias("catalog"),
        F.coalesce("schema", F.lit("Unknown")).alias("schema"),
        F.coalesce("data_source_format", F.lit("Unknown")).alias("format"),
        F.coalesce(location, F.lit("")).alias("location"),
        scalars.megabytes(F.col("size_bytes")).alias("size_mb"),
        F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
        "n_columns",
    )


def job_report(raw_jobs: DataFrame) -> DataFrame:
    rows = fields.job_run_as(fields.with_settings(raw_jobs))
    rows = fields.job_trigger(fields.job_type(rows))
    return rows.select("job_id", "name", "type", "run_as", "trigger")
