"""Counts, totals, facets, capped lists and unions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transhume import values
from transhume.functions import scalars
from transhume.operators.scan import is_auto


def risk_counts(df: DataFrame, classes: Sequence[str] = values.RISKS) -> DataFrame:
    """Assets per risk; the known classes are there even at zero, unset counts as green."""
    risk = F.coalesce("risk", F.lit("green")).alias("risk")
    counted = df.select(risk, F.lit(1).alias("n"))
    known = F.explode(F.array(*[F.lit(name) for name in classes])).alias("risk")
    zeros = df.sparkSession.range(1).select(known, F.lit(0).alias("n"))
    return counted.unionByName(zeros).groupBy("risk").agg(F.sum("n").alias("n"))


def readiness_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(is_auto()).alias("n_auto"), F.count_if(~is_auto()).alias("n_review")
    )


def storage_by_catalog(tables: DataFrame, price: float = values.STORAGE_PRICE) -> DataFrame:
    """Bytes, GB and monthly price per catalog; bytes are summed as integers, so exactly."""
    catalog = F.coalesce("catalog", F.lit("unknown")).alias("catalog")
    size = F.sum(F.coalesce("size_bytes", F.lit(0))).alias("size_bytes")
    summed = tables.groupBy(catalog).agg(size)
    summed = summed.withColumn("size_gb", scalars.gigabytes(F.col("size_bytes")))
    return summed.withColumn("monthly_storage_cost_usd", F.col("size_gb") * price)


def storage_totals(by_catalog: DataFrame) -> DataFrame:
    monthly = F.sum("monthly_storage_cost_usd")
    return by_catalog.agg(
        monthly.alias("total_monthly_usd"), (monthly * 12).alias("total_annual_usd")
    )


def summary_counts(**parts: DataFrame) -> DataFrame:
    """One row per named part with its row count."""
    counts = [
        part.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        for name, part in parts.items()
    ]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result


def facet_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).dropna().distinct().orderBy(col)


def work_list(df: DataFrame, key: str = "path", n: int = 3) -> DataFrame:
    """The first ``n`` by key: the size of a demonstration run, not a guard."""
    return df.orderBy(key).limit(n)


def union_inventory(**parts: DataFrame) -> DataFrame:
    """All parts as one feed with a ``kind``; columns a part lacks are null."""
    feeds = [part.withColumn("kind", F.lit(kind)) for kind, part in parts.items()]
    result = feeds[0]
    for other in feeds[1:]:
        result = result.unionByName(other, allowMissingColumns=True)
    return result


def storage_classes(
    tables: DataFrame, prices: Mapping[str, float] = values.STORAGE_CLASS_PRICES
) -> DataFrame:
    """Monthly price of all tables per storage class: one total, then one row per class."""
    total = tables.agg(F.sum(F.coalesce("size_bytes", F.lit(0))).alias("total_bytes"))
    classes = F.array(
        *[
            F.struct(F.lit(name).alias("storage_class"), F.lit(float(price)).alias("price"))
            for name, price in prices.items()
        ]
    )
    rows = total.select(
        scalars.gigabytes(F.col("total_bytes")).alias("total_gb"), F.inline(classes)
    )
    return rows.withColumn("monthly_cost_usd", F.col("total_gb") * F.col("price"))
