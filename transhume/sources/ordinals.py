"""Input order of listed items, as a dense number.

A DataFrame has no order, and several operators ask for the first or last of what a listing holds.  An item's
ordinal follows from its file (by name), the block of the file it is read from, its line there and its place in
the page's array.  Within a block Spark reads lines one after the other, so a running number of the task gives
line and place; what comes before a block is a sum over blocks.

The sums are taken in two steps.  Blocks are dealt to ranges in order; within a range a window adds them up, and
the totals of the ranges, one row for each, are added up on their own.  So no task sees all blocks, and the items
themselves are neither sorted nor shuffled for it: they are joined with the small table of blocks, which Spark
broadcasts where its size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transhume.session import scratch_dir

BLOCK = ["_file", "_block"]


def running_totals(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Each row with the sum of `value` over all rows before it in the order of the (unique) keys.

    The rows are written once to the shared folder, dealt to ranges, as a range must not change between
    the two sums."""
    spark = rows.sparkSession
    path = scratch_dir(spark, "ranges")
    ranged = rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    # a row for each range, as many as there are shuffle partitions
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_inner", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return summed.join(totals, "_range").withColumn(out, F.col("_base") + F.col("_inner")).drop("_range", "_base", "_inner")


def items_in_order(pages: DataFrame, array: str, order: str = "ord") -> DataFrame:
    """The items of all pages, from 0 on in the order they are listed.

    ``pages`` is a file source as it was read, with nothing done to it, so that both passes over it deal
    out the same blocks to the same tasks.  A page that can't be read, and one without the array, has none."""
    placed = pages.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.explode(array).alias("item"),
    ).withColumn("_row", F.monotonically_increasing_id())
    # counting the items themselves keeps whole pages read, so that damaged ones count alike in both passes
    blocks = placed.groupBy(*BLOCK).agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"), F.count("item").alias("_filled")
    )
    starts = running_totals(blocks, BLOCK, "_n", "_start").select(*BLOCK, "_first", "_start")
    numbered = placed.join(starts, BLOCK)
    return numbered.select("item.*", (F.col("_start") + F.col("_row") - F.col("_first")).alias(order))
