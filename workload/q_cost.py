"""Cost queries.  Sums of doubles are rounded, since their order is not fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transhume import values
from transhume.operators import aggregates, cost
from workload import views
from workload.q_reports import costs
from workload.registry import query
from workload.views import CLUSTERS, COSTS, TABLES, TOTALS, UNITS, with_

CLUSTER_COSTS = with_(CLUSTERS, COSTS)
ALL_TOTALS = with_(CLUSTERS, COSTS, TABLES, TOTALS)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({name: F.round(name, digits) for name in doubles})


@query(
    "cost_node_units",
    with_(CLUSTERS)
    + f"""SELECT cluster_id, node_type_id, {UNITS.format("node_type_id")}::INTEGER AS units
    FROM clusters_v""",
)
def cost_node_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = cost.node_units(F.col("node_type_id")).alias("units")
    return views.clusters(spark, sf_dir).select("cluster_id", "node_type_id", units)


@query("cost_workers", CLUSTER_COSTS + "SELECT cluster_id, workers::INTEGER AS workers FROM costs")
def cost_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers = cost.worker_count(F.col("num_workers"), F.col("autoscale.min_workers"))
    return views.clusters(spark, sf_dir).select("cluster_id", workers.alias("workers"))


@query(
    "cost_hours",
    CLUSTER_COSTS
    + f"""SELECT cluster_id, round(hours, 6) AS hours,
      round(CASE WHEN start_s IS NULL OR end_s IS NULL THEN hours ELSE greatest(0,
        (end_s - greatest(start_s, CASE WHEN start_time > 1000000000000 THEN start_s
          ELSE {views.AS_OF - 7 * 86400} END)) / 3600.0::DOUBLE) END, 6) AS old_hours
    FROM (SELECT *, greatest(0.0::DOUBLE, CASE WHEN start_s IS NULL THEN 24.0 * 7 * 0.25
      ELSE (coalesce(end_s, {views.AS_OF}::DOUBLE)
        - greatest(start_s, {views.AS_OF - 7 * 86400}::DOUBLE)) / 3600.0 END::DOUBLE) AS hours
      FROM costs_b)""",
)
def cost_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 7-day window, which cuts most clusters, in the right and in the compatible form."""
    args = (F.col("start_time"), F.col("terminated_time"), views.AS_OF, 7)
    return views.clusters(spark, sf_dir).select(
        "cluster_id",
        F.round(cost.active_hours(*args), 6).alias("hours"),
        F.round(cost.active_hours(*args, compat_clamp=True), 6).alias("old_hours"),
    )


@query(
    "cost_cluster",
    CLUSTER_COSTS
    + """SELECT cluster_id, driver_type, node_type_id AS worker_type, workers::INTEGER AS workers,
      round(dbu_hours, 4) AS dbu_hours, round(dbu_hours * 0.4, 4) AS estimated_cost_usd
    FROM costs""",
)
def cost_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(costs(spark, sf_dir).drop("ord"))


@query(
    "cost_compute_total",
    ALL_TOTALS
    + """SELECT round(hours, 4) AS total_dbu_hours, round(source_compute, 4) AS compute_cost_usd
    FROM totals""",
)
def cost_compute_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cost.compute_total(costs(spark, sf_dir)))


@query(
    "cost_storage",
    with_(TABLES)
    + """SELECT sum(coalesce(size_bytes, 0))::BIGINT AS total_bytes,
      round(sum(coalesce(size_bytes, 0))::BIGINT / 1073741824::DOUBLE, 4) AS total_gb,
      round(sum(coalesce(size_bytes, 0))::BIGINT / 1073741824::DOUBLE * 0.023, 4)
        AS monthly_storage_cost_usd FROM tables_v""",
)
def cost_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cost.storage_cost(views.tables(spark, sf_dir)))


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.target_cost(cost.compute_total(costs(spark, sf_dir)))


@query(
    "cost_target",
    ALL_TOTALS
    + f"""SELECT '{values.TARGET_MODEL}' AS model, round(hours, 4) AS vcpu_hours,
      round(hours * 2, 4) AS memory_gb_hours, round(target_compute, 4) AS compute_cost_usd
    FROM totals""",
)
def cost_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(target(spark, sf_dir))


@query(
    "cost_buffer",
    CLUSTER_COSTS
    + """SELECT cluster_id, round(dbu_hours * 0.4 * 1.15, 4) AS standard,
      round(dbu_hours * 0.4 * 1.5, 4) AS chosen FROM costs""",
)
def cost_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    usd = F.col("estimated_cost_usd")
    rows = costs(spark, sf_dir).select("cluster_id", usd.alias("standard"), usd.alias("chosen"))
    return rounded(cost.with_buffer(cost.with_buffer(rows, ["standard"]), ["chosen"], 0.5))


def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    compute = cost.compute_total(costs(spark, sf_dir))
    storage = cost.storage_cost(views.tables(spark, sf_dir))
    return cost.compare(compute, target(spark, sf_dir), storage)


@query(
    "cost_compare",
    ALL_TOTALS
    + """SELECT 'Compute (monthly)' AS metric, round(source_compute * 1.15, 3) AS source_usd,
      round(target_compute * 1.15, 3) AS target_usd FROM totals
    UNION ALL SELECT 'Storage (monthly)', round(storage * 1.15, 3), round(storage * 1.15, 3)
      FROM totals
    UNION ALL SELECT 'Total Monthly', round((source_compute + storage) * 1.15, 3),
      round((target_compute + storage) * 1.15, 3) FROM totals""",
)
def cost_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(comparison(spark, sf_dir), 3)


@query(
    "cost_roi",
    ALL_TOTALS
    + """SELECT round(s, 3) AS monthly_savings_usd, round(s * 12, 3) AS annual_savings_usd,
      round(greatest(1.0, s * 10), 3) AS migration_cost_estimate_usd,
      round(CASE WHEN s > 0 THEN greatest(1.0, s * 10) / s END, 3) AS months_to_recover
    FROM (SELECT (source_compute - target_compute) * 1.15 AS s FROM totals)""",
)
def cost_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = comparison(spark, sf_dir).where("metric = 'Total Monthly'")
    return rounded(cost.roi(total), 3)


@query(
    "cost_tips",
    CLUSTER_COSTS
    + f"""SELECT ord AS seq, 'Cluster ' || cluster_id
        || ' has high usage; consider profiling and right-sizing.' AS tip
      FROM (SELECT * FROM costs ORDER BY ord LIMIT 5) WHERE dbu_hours > 1000
      UNION ALL SELECT {2**62}, '{values.TIPS[0]}'
      UNION ALL SELECT {2**62 + 1}, '{values.TIPS[1]}'""",
)
def cost_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.tips(costs(spark, sf_dir))


@query(
    "cost_storage_classes",
    with_(TABLES)
    + """SELECT storage_class, round(gb, 4) AS total_gb, price, round(gb * price, 4)
        AS monthly_cost_usd
    FROM (SELECT sum(coalesce(size_bytes, 0))::BIGINT / 1073741824::DOUBLE AS gb FROM tables_v),
      (VALUES ('STANDARD', 0.023::DOUBLE), ('STANDARD_IA', 0.0125), ('GLACIER_IR', 0.004),
        ('GLACIER_FR', 0.0036)) AS classes(storage_class, price)""",
)
def cost_storage_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.storage_classes(views.tables(spark, sf_dir)))
