"""Workspace analysis from exported listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transhume.operators import aggregates, filters, scan
from transhume.plans import incremental
from transhume.session import scratch_dir
from transhume.sinks.reports import write_inventory
from transhume.sources import listings


def run_full(
    spark: SparkSession,
    export_dir: str,
    out_dir: str,
    as_of: str,
    table_format: str = "DELTA",
    other_tables: DataFrame | None = None,
    results: str | None = None,
) -> dict[str, DataFrame]:
    """Read the four listings, analyse the assets and write the snapshot.

    Tables of another known format than ``table_format`` are left out; when none is listed at all,
    ``other_tables`` (of an older metastore, say) take their place.

    The assets are decoded and joined once, into a scratch table, and analysed from there.  The parts
    returned are read from the snapshot too, so reports on them repeat none of the work.  With a folder of
    earlier ``results``, only sources whose content it lacks are scanned, and theirs are added to it.
    """
    assets = listings.read_assets(spark, f"{export_dir}/assets", f"{export_dir}/bodies")
    tables = filters.format_filter(
        listings.read_tables(spark, f"{export_dir}/tables"), table_format
    )
    if other_tables is not None:
        tables = listings.with_fallback(tables, other_tables)
    # The sources are kept as Parquet for the analysis; the JSON snapshot is written from that.
    kept = scratch_dir(spark, "assets")
    assets.write.parquet(kept)
    stored = spark.read.schema(assets.schema).parquet(kept)
    keep = ["size", "owner", "ord"]
    parts = {
        "assets": stored,
        "analyses": incremental.analyze(stored, results, keep=keep) if results else scan.analyze_assets(stored, keep=keep),
        "tables": tables,
        "jobs": listings.read_jobs(spark, f"{export_dir}/jobs"),
        "clusters": listings.read_clusters(spark, f"{export_dir}/clusters"),
    }
    write_inventory(parts, out_dir, as_of)

    def read(name: str, part: DataFrame) -> DataFrame:
        dated = part.withColumn("generated_at", F.lit("")).schema
        return spark.read.schema(dated).json(f"{out_dir}/{name}")

    return {name: read(name, part) for name, part in parts.items()}


def run_quick(spark: SparkSession, export_dir: str) -> DataFrame:
    """Count of the listed assets with a source; nothing is scanned."""
    assets = listings.read_assets(
        spark, f"{export_dir}/assets", f"{export_dir}/bodies", ordered=False
    )
    return aggregates.summary_counts(assets=assets)
