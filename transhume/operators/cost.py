"""Cost model: compute units and hours, storage, the target platform, buffer and return.

Everything per cluster is one projection; totals are one partial aggregation.  Totals of several
inputs meet as scalar subqueries of one-row results, so no cross join is planned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transhume import values
from transhume.functions import scalars
from transhume.operators.filters import high_usage

MS_FROM = 1e12  # fixed value: epoch numbers above are milliseconds


def node_units(node: Column) -> Column:
    """Units of a node type by its name; ``xlarge`` is looked for before ``large``."""
    return (
        F.when(F.contains(node, F.lit("xlarge")), 4)
        .when(F.contains(node, F.lit("large")), 8)
        .otherwise(4)
    )


def worker_count(num_workers: Column, min_workers: Column) -> Column:
    """Fixed size, else the lower autoscale bound, else none; zero counts as not given."""
    given = F.coalesce(F.nullif(num_workers, F.lit(0)), min_workers, F.lit(0))
    return F.greatest(given, F.lit(0)).cast("int")


def seconds(epoch: Column) -> Column:
    return F.when(epoch > MS_FROM, epoch / 1000.0).otherwise(epoch.cast("double"))


def active_hours(
    start: Column,
    end: Column,
    as_of: float,
    days: int = values.LOOKBACK_DAYS,
    utilization: float = values.UTILIZATION,
    compat_clamp: bool = False,
) -> Column:
    """Hours inside the window that ends at ``as_of`` (epoch seconds, UTC).

    Without a start a share of the window is assumed.  ``compat_clamp`` compares the raw start
    with a window start in seconds, which leaves millisecond starts of ended clusters unclamped.
    """
    window_start = as_of - days * 86400
    start, end = F.nullif(start, F.lit(0)), F.nullif(end, F.lit(0))
    since = F.greatest(seconds(start), F.lit(float(window_start)))
    if compat_clamp:
        ended_since = seconds(F.greatest(start, F.lit(int(window_start))))
    else:
        ended_since = since
    hours = (
        F.when(start.isNull(), F.lit(24.0 * days * utilization))
        .when(end.isNull(), (F.lit(float(as_of)) - since) / 3600.0)
        .otherwise((seconds(end) - ended_since) / 3600.0)
    )
    return F.greatest(hours, F.lit(0.0))


def cluster_cost(
    clusters: DataFrame,
    as_of: float,
    price: float | Column = values.UNIT_PRICE,
    days: int = values.LOOKBACK_DAYS,
    utilization: float = values.UTILIZATION,
    compat_clamp: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Units, hours and price per cluster, with the ``keep`` columns of the input."""
    blank = scalars.unless
    worker_type = F.col("node_type_id")
    driver_type = F.coalesce(blank(F.col("driver_node_type_id"), ""), worker_type)
    workers = worker_count(F.col("num_workers"), F.col("autoscale.min_workers"))
    hours = active_hours(
        scalars.first_set([F.col("start_time"), F.col("created_time")], 0),
        scalars.first_set([F.col("terminated_time"), F.col("end_time")], 0),
        as_of,
        days,
        utilization,
        compat_clamp,
    )
    unit_price = price if isinstance(price, Column) else F.lit(float(price))
    units = node_units(driver_type) + workers * node_units(worker_type)
    costed = clusters.select(
        "cluster_id",
        driver_type.alias("driver_type"),
        worker_type.alias("worker_type"),
        workers.alias("workers"),
        (units * hours).alias("dbu_hours"),
        unit_price.alias("_price"),
        *keep,
    )
    cost = F.col("dbu_hours") * F.col("_price")
    return costed.withColumn("estimated_cost_usd", cost).drop("_price")


def compute_total(costs: DataFrame) -> DataFrame:
    """Totals over all clusters, zero when there are none."""
    return costs.agg(
        F.coalesce(F.sum("dbu_hours"), F.lit(0.0)).alias("total_dbu_hours"),
        F.coalesce(F.sum("estimated_cost_usd"), F.lit(0.0)).alias("compute_cost_usd"),
    )


def storage_cost(tables: DataFrame, price: float = values.STORAGE_PRICE) -> DataFrame:
    total = F.coalesce(F.sum(F.coalesce("size_bytes", F.lit(0))), F.lit(0))
    sized = tables.agg(total.alias("total_bytes"))
    sized = sized.withColumn("total_gb", scalars.gigabytes(F.col("total_bytes")))
    return sized.withColumn("monthly_storage_cost_usd", F.col("total_gb") * price)


def target_cost(
    compute: DataFrame,
    vcpu_price: float = values.VCPU_PRICE,
    memory_price: float = values.MEMORY_PRICE,
) -> DataFrame:
    """Target platform estimate: a vCPU hour per unit hour, and two GB of memory each."""
    vcpu_hours = F.coalesce("total_dbu_hours", F.lit(0.0))
    cost = F.col("vcpu_hours") * vcpu_price + F.col("memory_gb_hours") * memory_price
    mapped = compute.select(
        F.lit(values.TARGET_MODEL).alias("model"),
        vcpu_hours.alias("vcpu_hours"),
        (vcpu_hours * 2).alias("memory_gb_hours"),
    )
    return mapped.withColumn("compute_cost_usd", cost)


def with_buffer(df: DataFrame, cols: Sequence[str], pct: float = values.BUFFER) -> DataFrame:
    return df.withColumns({name: F.col(name) * (1.0 + pct) for name in cols})


def compare(
    compute: DataFrame, target: DataFrame, storage: DataFrame, pct: float = values.BUFFER
) -> DataFrame:
    """Compute, storage and total per month on both sides, with the buffer."""
    storage_usd = storage.select("monthly_storage_cost_usd")
    both = compute.select(
        F.col("compute_cost_usd").alias("source_compute"),
        target.select("compute_cost_usd").scalar().alias("target_compute"),
        storage_usd.scalar().alias("storage"),
    )
    both = with_buffer(both, ["source_compute", "target_compute", "storage"], pct)

    def row(name: str, source: Column, target_usd: Column) -> Column:
        return F.struct(
            F.lit(name).alias("metric"), source.alias("source_usd"), target_usd.alias("target_usd")
        )

    source, target_usd, stored = F.col("source_compute"), F.col("target_compute"), F.col("storage")
    return both.select(
        F.inline(
            F.array(
                row("Compute (monthly)", source, target_usd),
                row("Storage (monthly)", stored, stored),
                row("Total Monthly", source + stored, target_usd + stored),
            )
        )
    )


def roi(df: DataFrame, source: str = "source_usd", target: str = "target_usd") -> DataFrame:
    """Savings per month and year, the assumed one-off cost, and months to recover it."""
    savings = F.col("monthly_savings_usd")
    one_off = F.greatest(F.lit(1.0), savings * 10)
    return df.select(
        (F.col(source) - F.col(target)).alias("monthly_savings_usd")
    ).select(
        savings,
        (savings * 12).alias("annual_savings_usd"),
        one_off.alias("migration_cost_estimate_usd"),
        F.when(savings > 0, one_off / savings).alias("months_to_recover"),
    )


def tips(costs: DataFrame, fixed: Sequence[str] = values.TIPS, n: int = 5) -> DataFrame:
    """One tip per high-usage cluster in input order, then the fixed ones: (seq, tip), by seq."""
    text = F.format_string(values.CLUSTER_TIP, F.coalesce("cluster_id", F.lit("None")))
    found = high_usage(costs, n=n).select(F.col("ord").cast("long").alias("seq"), text.alias("tip"))
    last = 2**62
    rows = [
        F.struct(F.lit(last + i).alias("seq"), F.lit(tip).alias("tip"))
        for i, tip in enumerate(fixed)
    ]
    if not rows:
        return found
    return found.unionByName(costs.sparkSession.range(1).select(F.inline(F.array(*rows))))
