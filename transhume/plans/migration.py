"""Table moves: export with sidecars, and checks of the copies."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from transhume.functions import scalars
from transhume.operators.fields import dest_key, existing, fq_name
from transhume.plans.table_files import copy_tables
from transhume.session import scratch_dir
from transhume.sinks.reports import HIDDEN_SIDECAR, SIDECAR, export_table, write_sidecars

# What an export needs to know of a table, as far as the listing has it.
EXPORT_COLUMNS = (
    "full_name",
    "catalog",
    "schema",
    "db",
    "name",
    "table_name",
    "storage_location",
    "location",
    "source_format",
    "data_source_format",
)
# Parts that keys are dealt to by hash, of which a share is compared.
SHARES = 1_000_000_000
STATUS = "dest_key STRING, n_rows LONG, ok BOOLEAN, error STRING"
# Formats whose readers go by a log, not by the files in the folder.
KEEPS_LOG = ("delta", "iceberg", "hudi")
CLASH = "tables of different places have this key"


def location_of(tables: DataFrame) -> Column:
    """The first place that is listed, or null."""
    return scalars.first_set([F.lit(None).cast("string"), *existing(tables, "storage_location", "location")], "")


def as_files(tables: DataFrame, location: Column, fmt: str) -> Column:
    """Whether a table is Parquet by its listing, has a place without wildcards, and is to be Parquet."""
    formats = existing(tables, "source_format", "data_source_format")
    listed = F.lower(scalars.first_set([F.lit(None).cast("string"), *formats], ""))
    plain = location.isNotNull() & ~location.rlike(r"[*?{\[]")
    return F.coalesce(F.lit(fmt.lower() == "parquet") & (listed == "parquet") & plain, F.lit(False))


def migrate_tables(
    spark: SparkSession,
    tables: DataFrame,
    root: str,
    fmt: str = "parquet",
    parallel: int = 4,
    batch: int = 200,
) -> DataFrame:
    """Export and sidecar of every table, and a status row for every row handed in.

    Tables listed as Parquet with a location, to be Parquet again, are moved as files, all of them by
    one listing and one copy (``table_files``).  Any other export reads a table and writes it in another
    format, which is a Spark job of its own; a few run side by side so that small tables do not leave
    the cluster idle.  Names and places of these pass through the driver ``batch`` tables at a time, and
    each batch's outcome is appended to a log.

    Sidecars are written last, by one job, as an export replaces what is in its folder.  Beside the
    files of a plain format their name begins with an underscore, or readers would take them for data.

    A table listed twice is moved once, and both rows get its status.  Tables of different places
    under one key would overwrite each other: none of them is moved, and each row says so.
    """
    wanted = [name for name in EXPORT_COLUMNS if name in tables.columns]
    rows = dest_key(fq_name(tables)).withColumn("_place", F.xxhash64(*wanted))
    by_key = rows.groupBy("dest_key").agg(
        F.min("_place").alias("_place"), (F.min("_place") != F.max("_place")).alias("_clash")
    )
    chosen = rows.join(by_key.where("NOT _clash").drop("_clash"), ["dest_key", "_place"])
    chosen = chosen.dropDuplicates(["dest_key"])
    export_log = scratch_dir(spark, "export-status")

    def move(row: Row) -> tuple:
        try:
            _, n_rows = export_table(spark, row.asDict(), root, fmt)
            return row["dest_key"], n_rows, True, None
        except Exception as error:
            return row["dest_key"], None, False, str(error).split("\n", 1)[0]

    spark.createDataFrame([], STATUS).write.parquet(export_log)
    chosen = chosen.withColumn("_location", location_of(tables)).withColumn(
        "_as_files", as_files(tables, F.col("_location"), fmt)
    )
    plan = scratch_dir(spark, "export-plan")
    chosen.write.parquet(plan)
    chosen = spark.read.schema(chosen.schema).parquet(plan)
    by_files = chosen.where("_as_files").select("dest_key", F.col("_location").alias("location"))
    copied = copy_tables(by_files, root).select("dest_key", "n_rows", "ok", "error")
    copied.write.mode("append").parquet(export_log)
    listed = chosen.where("NOT _as_files").select("dest_key", *wanted).toLocalIterator()
    with ThreadPoolExecutor(parallel) as pool:
        while some := list(islice(listed, batch)):
            moved = spark.createDataFrame(list(pool.map(move, some)), STATUS)
            moved.coalesce(1).write.mode("append").parquet(export_log)
    done = spark.read.schema(STATUS).parquet(export_log)
    named = chosen.join(done.select("dest_key", "ok"), "dest_key", "left")
    hidden = F.lit(fmt.lower() not in KEEPS_LOG) & F.coalesce("ok", F.lit(False))
    name = F.when(hidden, HIDDEN_SIDECAR).otherwise(SIDECAR)
    sidecar_log = scratch_dir(spark, "sidecar-status")
    described = named.select(*tables.columns, name.alias("_sidecar"))
    write_sidecars(described, root, F.col("_sidecar")).write.parquet(sidecar_log)
    key = F.regexp_replace("key", "/_?schema.json$", "").alias("dest_key")
    sidecars = spark.read.parquet(sidecar_log).groupBy(key).agg(F.bool_and("ok").alias("sidecar_ok"))
    status = rows.select("fq_name", "dest_key").join(by_key, "dest_key")
    status = status.join(done, "dest_key", "left").join(sidecars, "dest_key", "left")
    return status.select(
        "dest_key",
        "fq_name",
        "n_rows",
        F.coalesce("ok", F.lit(False)).alias("ok"),
        F.when(F.col("_clash"), CLASH).otherwise(F.col("error")).alias("error"),
        "sidecar_ok",
    )


def hashable(df: DataFrame, name: str) -> Column:
    """The column, as JSON text where it holds maps or variants, which have no hash."""
    kind = df.schema[name].dataType.simpleString()
    column = F.col(f"`{name}`")
    return F.to_json(F.struct(column)) if "map<" in kind or "variant" in kind else column


def fingerprint(df: DataFrame, cols: list[str]) -> DataFrame:
    """Row count and two order-free sums over row hashes, as one row.

    The sum tells repeated rows apart, the xor needs no wide numbers; both combine map-side.
    """
    row_hash = F.xxhash64(*[hashable(df, name) for name in sorted(cols)])
    return df.select(row_hash.alias("h")).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.col("h").cast("decimal(20,0)")), F.lit(0)).alias("hash_sum"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("hash_xor"),
    )


def validate_export(
    source: DataFrame,
    copy: DataFrame,
    keys: list[str] | None = None,
    pct: float | None = None,
) -> DataFrame:
    """One row: counts on both sides, and whether count, schema and content agree.

    With ``pct`` the contents are compared on the same share of the keys on both sides, picked by
    key hash; counts always cover everything.  Where the share holds no row of a table that has some,
    nothing was compared and ``content_ok`` is null.
    """
    spark = source.sparkSession
    cols = sorted(set(source.columns) & set(copy.columns))

    def types_of(df: DataFrame) -> list:
        return sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)

    whole = pct is None or pct >= 100

    def share(df: DataFrame) -> DataFrame:
        bucket = F.pmod(F.xxhash64(*[hashable(df, name) for name in keys or cols]), F.lit(SHARES))
        return df if whole else df.where(bucket * F.lit(100.0) < F.lit(float(pct) * SHARES))

    def one(df: DataFrame) -> DataFrame:
        total = F.col("n") if whole else df.agg(F.count(F.lit(1)).alias("total")).scalar()
        return fingerprint(share(df), cols).select(F.struct(total.alias("total"), "*"))

    sides = spark.range(1).select(
        one(source).scalar().alias("a"), one(copy).scalar().alias("b")
    )
    same = (F.col("a.hash_sum") == F.col("b.hash_sum")) & (
        F.col("a.hash_xor") == F.col("b.hash_xor")
    )
    seen, there = F.greatest("a.n", "b.n"), F.greatest("a.total", "b.total")
    compared = (seen > 0) | (there == 0)
    return sides.select(
        F.col("a.total").alias("source_rows"),
        F.col("b.total").alias("copy_rows"),
        (F.col("a.total") == F.col("b.total")).alias("count_ok"),
        F.lit(types_of(source) == types_of(copy)).alias("schema_ok"),
        F.when(compared, same & (F.col("a.n") == F.col("b.n"))).alias("content_ok"),
    )
