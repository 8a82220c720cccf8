"""Tables kept as plain Parquet files, moved as files: all of them by one listing and one copy.

A table whose format stays the same needs no job of its own.  The folders of all tables are listed level by
level at a time, their files are dealt over the cluster (long ones by ranges), and the rows are counted in the
footers of the copies.  Names and places never pass through the driver, so the number of tables is not bound
by it, and one huge table is spread like many small ones.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyarrow import parquet
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transhume.session import scratch_dir
from transhume.sinks import parts
from transhume.sinks.objects import STATUS, width, with_scheme
from transhume.sources.files import walk
from transhume.storage import open_root, resolve

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COUNTED = "key STRING, n_rows BIGINT, error STRING"
NO_FILES = "no data files at its location"
LOGGED = "its folder has a table log"
INSIDE = "its location is in the folder that the move would replace"
#: Places that tell that not all files of a folder are the table's.
LOG_PLACE = r"^(_delta_log/|\.hoodie/|metadata/.*\.metadata\.json$)"


def data_file(place: Column) -> Column:
    """Whether Spark reads the file as data: not hidden, and directly in the folder or in one by partition."""
    names = F.split(place, "/")
    name = F.element_at(names, -1)
    hidden = name.startswith(".") | (name.startswith("_") & ~F.contains(name, F.lit("=")))
    by_partition = F.forall(
        F.slice(names, 1, F.size(names) - 1), lambda p: F.contains(p, F.lit("=")) & ~p.startswith(".")
    )
    return by_partition & ~hidden


def walk_tables(starts: DataFrame) -> DataFrame:
    """dest_key, path, place, length and time of all files below the (dest_key, path) of each table.

    A key may hold slashes, so files find back to it by its hash.
    """
    spark = starts.sparkSession
    starts = starts.select("*", F.sha2("dest_key", 256).alias("relative"))
    found = walk(spark, starts, must_exist=False)
    found = found.withColumn("_key", F.substring_index("relative", "/", 1))
    keys = starts.select("dest_key", F.col("relative").alias("_key"))
    place = F.expr("substr(relative, length(_key) + 2)")
    return found.withColumn("place", place).join(keys, "_key").drop("_key", "relative")


def count_rows(keys: DataFrame, root: str) -> DataFrame:
    """key, n_rows and error of the Parquet files at the given keys, from their footers."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_root(root)
        for batch in batches:
            found = []
            for key in batch["key"]:
                try:
                    with store.open_input_file(f"{base}/{key}") as data:
                        found.append((key, parquet.ParquetFile(data).metadata.num_rows, None))
                except Exception as error:
                    found.append((key, None, str(error)))
            rows = pd.DataFrame(found, columns=["key", "n_rows", "error"])
            yield rows.astype({"n_rows": "Int64"})

    root = resolve(keys.sparkSession, root)
    return keys.repartition(width(keys), "key").mapInPandas(work, COUNTED)


def remove_files(keys: DataFrame, root: str) -> DataFrame:
    """Delete the files at the given keys; gives status rows."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_root(root)
        for batch in batches:
            found = []
            for key in batch["key"]:
                try:
                    store.delete_file(f"{base}/{key}")
                    found.append((key, 0, True, None))
                except FileNotFoundError:
                    found.append((key, 0, True, None))  # by the task that ran before
                except Exception as error:
                    found.append((key, 0, False, str(error)))
            yield pd.DataFrame(found, columns=["key", "n_bytes", "ok", "error"])

    root = resolve(keys.sparkSession, root)
    return keys.repartition(width(keys), "key").mapInPandas(work, STATUS)


def copy_tables(
    tables: DataFrame, root: str, part_bytes: int = parts.PART, verify: bool = False
) -> DataFrame:
    """dest_key, n_files, n_bytes, n_rows, ok and error of every (dest_key, location).

    Each location is a folder of Parquet files, in folders by partition or not, or one file; each key
    comes once.  Hidden files are left out.  What an earlier export left at the key goes once the new
    files are whole, so a failed move leaves the old ones.  Folders with a table log hold files that are no
    longer the table's: nothing is copied, and the row says so.  With ``verify`` every range is read
    again on both sides.  An empty listing gives no rows.
    """
    spark = tables.sparkSession
    root = resolve(spark, root)
    log = scratch_dir(spark, "table-files")
    tables.select("dest_key", with_scheme(tables, "location").alias("path")).write.parquet(f"{log}/starts")
    starts = spark.read.parquet(f"{log}/starts")
    place_of_copy = F.concat(F.lit(f"{root}/"), "dest_key", F.lit("/"))
    inside = F.concat("path", F.lit("/")).startswith(place_of_copy)
    keys = starts.select("dest_key", inside.alias("inside"))
    starts = starts.where(~inside)
    target = F.concat_ws("/", "dest_key", "place")
    walk_tables(starts).withColumn("relative", target).write.parquet(f"{log}/listed")
    listed = spark.read.parquet(f"{log}/listed")
    logged = listed.where(F.col("place").rlike(LOG_PLACE)).select("dest_key").distinct()
    data = listed.where(data_file(F.col("place"))).join(logged, "dest_key", "left_anti")
    manifest = data.select("path", "relative", "length", "modified_at")

    parts.copy_large(manifest, root, part_bytes).write.parquet(f"{log}/copied")
    copied = spark.read.schema(STATUS).parquet(f"{log}/copied")
    count_rows(copied.where("ok").select("key"), root).write.parquet(f"{log}/counted")
    counted = spark.read.schema(COUNTED).parquet(f"{log}/counted")
    each = copied.join(counted.withColumnRenamed("error", "unread"), "key", "left")
    each = each.withColumn("error", F.coalesce("error", "unread"))
    if verify:
        parts.compare_files(manifest, root, part_bytes).write.parquet(f"{log}/compared")
        differing = spark.read.parquet(f"{log}/compared").where("n_differing > 0")
        each = each.join(differing.select("key", "first_differing"), "key", "left")
        differs = F.concat(F.lit("differs from its source at "), F.col("first_differing"))
        each = each.withColumn("error", F.coalesce("error", differs))
    files = data.select("dest_key", F.col("relative").alias("key")).join(each, "key", "left")
    done = files.groupBy("dest_key").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("n_bytes").alias("n_bytes"),
        F.sum("n_rows").alias("n_rows"),
        F.min("error").alias("error"),
        F.bool_and(F.coalesce("ok", F.lit(False))).alias("whole"),
    )
    why = F.when(F.col("inside"), INSIDE).when(F.col("logged"), LOGGED).when(F.col("n_files").isNull(), NO_FILES)
    status = keys.join(done, "dest_key", "left").join(
        logged.withColumn("logged", F.lit(True)), "dest_key", "left"
    )
    status = status.select(
        "dest_key",
        F.coalesce("n_files", F.lit(0)).alias("n_files"),
        F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"),
        F.when(F.col("error").isNull(), F.col("n_rows")).alias("n_rows"),
        F.coalesce(F.col("whole") & F.col("error").isNull(), F.lit(False)).alias("ok"),
        F.coalesce("error", why).alias("error"),
    )
    status.write.parquet(f"{log}/status")
    status = spark.read.schema(status.schema).parquet(f"{log}/status")

    there = status.where("ok").select("dest_key", place_of_copy.alias("path"))
    walk_tables(there).withColumn("key", target).write.parquet(f"{log}/there")
    old = spark.read.parquet(f"{log}/there").where(data_file(F.col("place")))
    stale = old.join(manifest.select(F.col("relative").alias("key")), "key", "left_anti")
    remove_files(stale.select("key"), root).write.parquet(f"{log}/removed")
    failed = spark.read.schema(STATUS).parquet(f"{log}/removed").where("NOT ok")
    failed = failed.join(old.select("key", "dest_key"), "key")
    failed = failed.groupBy("dest_key").agg(F.min("error").alias("kept"))
    return status.join(failed, "dest_key", "left").select(
        "dest_key",
        "n_files",
        "n_bytes",
        "n_rows",
        (F.col("ok") & F.col("kept").isNull()).alias("ok"),
        F.coalesce("error", "kept").alias("error"),
    )
