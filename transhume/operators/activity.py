"""Active hours of clusters that are listed more than once.

An export that was put together from several listings has a cluster several times, with intervals that repeat and
overlap.  Summing them counts an hour more than once.  Here the intervals of a cluster are united: ordered by
their start, an interval adds what lies beyond the latest end before it.

Intervals are cut at the days of the window first, and united day by day.  The pieces of one day don't overlap
those of another, so the days add up, and a cluster with very many intervals is spread over as many tasks as
the window has days.  Equal pieces are combined before they are sent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transhume import values
from transhume.functions import scalars
from transhume.operators import cost
from transhume.operators.joins import one_per_key

DAY = 86400


def intervals(clusters: DataFrame, as_of: float, days: int = values.LOOKBACK_DAYS, key: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """key, day, since, until of the parts of each listed interval that lie in the window (epoch seconds).

    An interval without an end lasts until ``as_of``; one without a start gives none."""
    begin = float(as_of - days * DAY)
    start = scalars.first_set([F.col("start_time"), F.col("created_time")], 0)
    end = scalars.first_set([F.col("terminated_time"), F.col("end_time")], 0)
    rows = clusters.select(
        *key,
        F.greatest(cost.seconds(start), F.lit(begin)).alias("since"),
        F.coalesce(cost.seconds(end), F.lit(float(as_of))).alias("until"),
        start.isNotNull().alias("_known"),
    ).where("_known AND until > since")
    first, last = (F.floor((F.col(c) - begin) / DAY).cast("int") for c in ("since", "until"))
    rows = rows.withColumn("day", F.explode(F.sequence(first, F.greatest(first, last))))
    day = F.lit(begin) + F.col("day") * DAY
    rows = rows.select(*key, "day", F.greatest("since", day).alias("since"), F.least("until", day + DAY).alias("until"))
    return rows.where("until > since").distinct()


def united(pieces: DataFrame, key: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """key, hours: the length of the union of each key's pieces."""
    order = Window.partitionBy(*key, "day").orderBy("since", "until")
    before = F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("until") - F.greatest("since", F.coalesce(before, F.col("since"))), F.lit(0.0))
    rows = pieces.select(*key, fresh.alias("seconds"))
    return rows.groupBy(*key).agg((F.sum("seconds") / 3600.0).alias("hours"))


def islands(pieces: DataFrame, key: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """key, since, until of the gapless stretches within each day."""
    order = Window.partitionBy(*key, "day").orderBy("since", "until")
    before = F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("since") > before, F.lit(True)).cast("int")
    rows = pieces.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*key, "day", "_island").agg(F.min("since").alias("since"), F.max("until").alias("until")).drop("_island")


def cluster_cost_once(
    clusters: DataFrame,
    as_of: float,
    price: float | Column = values.UNIT_PRICE,
    days: int = values.LOOKBACK_DAYS,
    utilization: float = values.UTILIZATION,
    order: str = "ord",
) -> DataFrame:
    """One row for each cluster: units, united hours and price, with the number of times it is listed.

    Node types and workers are those of the last listing by ``order``, which is kept.  A cluster of
    which no listing has a start is taken as active for the usual share of the window, once.  Rows without
    an id are one cluster each."""
    named = clusters.withColumn(
        "_key", F.coalesce(F.concat(F.lit("c"), "cluster_id"), F.concat(F.lit("r"), F.col(order).cast("string")))
    )
    key = ["_key"]
    hours = united(intervals(named, as_of, days, key), key)
    started = named.groupBy(*key).agg(
        F.count(F.lit(1)).alias("listed"),
        F.max(scalars.first_set([F.col("start_time"), F.col("created_time")], 0).isNotNull()).alias("_started"),
    )
    fields = ["_key", "cluster_id", order, "num_workers", "autoscale", "driver_node_type_id", "node_type_id"]
    last = one_per_key(named.select(*fields, F.col(order).alias("_order")), key, "_order", last=True)
    joined = last.join(started, key).join(hours, key, "left")
    whole = F.when(F.col("_started"), F.coalesce("hours", F.lit(0.0))).otherwise(24.0 * days * utilization)
    worker_type = F.col("node_type_id")
    driver_type = F.coalesce(scalars.unless(F.col("driver_node_type_id"), ""), worker_type)
    workers = cost.worker_count(F.col("num_workers"), F.col("autoscale.min_workers"))
    units = cost.node_units(driver_type) + workers * cost.node_units(worker_type)
    unit_price = price if isinstance(price, Column) else F.lit(float(price))
    return joined.select(
        order,
        "cluster_id",
        "listed",
        driver_type.alias("driver_type"),
        worker_type.alias("worker_type"),
        workers.alias("workers"),
        whole.alias("hours"),
        (units * whole).alias("dbu_hours"),
        (units * whole * unit_price).alias("estimated_cost_usd"),
    )
