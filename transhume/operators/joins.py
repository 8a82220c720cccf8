"""Joins by key.

Duplicates are resolved before a join by ``min_by``/``max_by`` aggregation.  Over rows and texts those sort
within each task, and combine there, so a key holding a large share of the rows sends one row per
task, where ranking its rows would sort them all in one.  No side is forced to broadcast: Spark does that where measured
sizes allow, and splits skewed partitions of sort-merge joins otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transhume.functions import scalars
from transhume.operators import fields

TABLE_KEY = ("catalog", "schema", "name")


def one_per_key(
    df: DataFrame, keys: Sequence[str], order: str = "ord", last: bool = False
) -> DataFrame:
    """The first (or last) row of every key by ``order``."""
    others = [name for name in df.columns if name not in keys]
    pick = F.max_by if last else F.min_by
    chosen = df.groupBy(*keys).agg(pick(F.struct(*others), F.col(order)).alias("_row"))
    return chosen.select(*keys, "_row.*")


def with_analysis(assets: DataFrame, analyses: DataFrame, order: str = "ord") -> DataFrame:
    """Assets with the last analysis of their path; ``unknown`` risk where there is none."""
    latest = one_per_key(analyses.where("path != ''"), ["path"], order, last=True).drop(order)
    joined = assets.join(latest, "path", "left")
    return joined.withColumn("risk", F.coalesce("risk", F.lit("unknown")))


def resolve_tables(names: DataFrame, tables: DataFrame, order: str = "ord") -> DataFrame:
    """The first table row of every selected ``fq_name``; names without one are left out.

    Tables are cut to one row per key before the join, so a key listed over and over is combined
    map-side; the join then reuses that partitioning.
    """
    wanted = fields.parse_fq(names.select("fq_name").distinct(), "fq_name")
    return one_per_key(tables, TABLE_KEY, order).join(wanted, list(TABLE_KEY))


def missing_tables(names: DataFrame, tables: DataFrame) -> DataFrame:
    """The selected names no table has; repeated tables are combined before the join."""
    wanted = fields.parse_fq(names.select("fq_name").distinct(), "fq_name")
    listed = tables.select(*TABLE_KEY).distinct()
    return wanted.join(listed, list(TABLE_KEY), "left_anti").select("fq_name")


def with_columns_detail(tables: DataFrame, details: DataFrame) -> DataFrame:
    """Tables with their looked-up columns, or the listed ones where the lookup gave none."""
    found = details.where(F.size("columns") > 0).groupBy(*TABLE_KEY)
    found = found.agg(F.min("columns").alias("_columns"))
    joined = tables.join(found, list(TABLE_KEY), "left")
    return joined.withColumn("columns", F.coalesce("_columns", "columns")).drop("_columns")


def with_body(
    listing: DataFrame, bodies: DataFrame, distinct_paths: bool = False
) -> DataFrame:
    """Listed assets with their source and its length; assets without a source are left out.

    A path exported more than once has one source, the one whose hash sorts first, so a path repeated on
    both sides cannot multiply.  The sources are read, decoded and shuffled once: those of a path are
    combined before the shuffle, and the listing joins what is left by the same key.  Where the export
    is known to hold each path once, ``distinct_paths`` saves the choice.
    """
    sources = bodies.select("path", "content").where(F.length("content") > 0)
    if not distinct_paths:
        first = F.min(F.struct(F.xxhash64("content").alias("hash"), "content"))
        sources = sources.groupBy("path").agg(first.alias("_first"))
        sources = sources.select("path", F.col("_first.content").alias("content"))
    joined = listing.join(sources, "path").select(*listing.columns, "content")
    return joined.withColumn("size", F.length("content"))


def status_owner() -> Column:
    """Owner of a status row.  Fixed values: its five places, in this order."""
    meta = F.col("object_meta")
    places = [
        F.col("owner"),
        meta["owner"],
        meta["created_by"],
        F.col("created_by"),
        meta["created_by_user"],
    ]
    return scalars.first_set(places, "")


def with_owner(assets: DataFrame, status: DataFrame) -> DataFrame:
    """Assets with a missing owner filled in from the status table, else left empty."""
    owners = status.select("path", status_owner().alias("_owner")).where("_owner IS NOT NULL")
    owners = owners.groupBy("path").agg(F.min("_owner").alias("_owner"))
    joined = assets.join(owners, "path", "left")
    owner = F.coalesce(scalars.unless(F.col("owner"), ""), F.col("_owner"), F.lit(""))
    return joined.withColumn("owner", owner).drop("_owner")


def with_prices(df: DataFrame, prices: DataFrame, defaults: Mapping[str, float]) -> DataFrame:
    """Add one column per price, from the (key, value) table or else the default.

    The prices come as one scalar subquery over the wanted keys, so no join is planned.
    """
    wanted = prices.where(F.col("key").isin(*defaults))
    found = wanted.agg(
        F.struct(
            *[F.max(F.when(F.col("key") == key, F.col("value"))).alias(key) for key in defaults]
        ).alias("found")
    )
    priced = df.withColumn("_prices", found.scalar())
    columns = {
        key: F.coalesce(F.col("_prices")[key].cast("double"), F.lit(float(value)))
        for key, value in defaults.items()
    }
    return priced.withColumns(columns).drop("_prices")


def review_list(df: DataFrame) -> DataFrame:
    """Everything that is not an automatic candidate; null fields land here too."""
    auto = (F.col("complexity") == "simple") & (F.col("issues") == "")
    return df.where(~F.coalesce(auto, F.lit(False)))


def auto_list(df: DataFrame) -> DataFrame:
    return df.where((F.col("complexity") == "simple") & (F.col("issues") == ""))
