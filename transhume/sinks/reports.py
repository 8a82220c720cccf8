"""Table exports and report files, all by Spark's own writers."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from transhume.operators.fields import dest_key, existing
from transhume.operators.rewrite import diff_ops, op_list
from transhume.schemas import COLUMN_LIST
from transhume.sinks.objects import put_texts
from transhume.sources.files import read_table
from transhume.values import ASSETS_PREFIX, REWRITES, TABLES_PREFIX

# Readers of plain files would take the sidecar for data, but for names with an underscore.
SIDECAR = "schema.json"
HIDDEN_SIDECAR = "_schema.json"

# One task reads a packed file whole, so its rows are bounded.  The default level takes twice the time for files
# a twentieth smaller.
PACKED = {"compression": "gzip", "zlib.compress.level": "FOUR", "maxRecordsPerFile": 1000}


def export_table(
    spark: SparkSession, info: Mapping, root: str, fmt: str = "parquet"
) -> tuple[str, int]:
    """Write a table below ``root`` at its key; gives the place and the number of rows.

    Rows are counted by an observation while they are written, so the data is read once.
    """
    parts = (
        info.get("catalog"),
        info.get("schema") or info.get("db"),
        info.get("name") or info.get("table_name"),
    )
    ref = info.get("full_name") or (".".join(parts) if all(parts) else None)
    location = info.get("storage_location") or info.get("location")
    data = read_table(spark, ref, location, info.get("source_format") or fmt)
    key = "/".join(part or default for part, default in zip(parts, ("default", "default", "table")))
    place = f"{root.rstrip('/')}/{TABLES_PREFIX}/{key}"
    seen = Observation()
    data = data.observe(seen, F.count(F.lit(1)).alias("n"))
    data.write.format(fmt).mode("overwrite").option("overwriteSchema", "true").save(place)
    return place, seen.get["n"]


def sidecar(df: DataFrame) -> Column:
    """Schema sidecar JSON of a table row, with every key present."""

    def col(name: str, kind: str = "string") -> Column:
        found = existing(df, name)
        return (found[0] if found else F.lit(None)).cast(kind)

    empty = F.array().cast("array<string>")
    members = [
        *[col(n).alias(n) for n in ("name", "catalog", "schema", "table_type")],
        col("storage_location").alias("storage_location"),
        col("size_bytes", "bigint").alias("size_bytes"),
        *[col(n).alias(n) for n in ("created_at", "updated_at", "owner")],
        F.coalesce(col("columns", COLUMN_LIST), F.array().cast(COLUMN_LIST)).alias("columns"),
        F.coalesce(col("partitions", "array<string>"), empty).alias("partitions"),
        F.coalesce(col("comment"), F.lit("")).alias("notes"),
    ]
    return F.to_json(F.struct(*members), {"ignoreNullFields": "false"})


def write_sidecars(tables: DataFrame, root: str, name: Column | str = SIDECAR) -> DataFrame:
    """One ``schema.json`` per table beside its data, or as ``name`` says; gives status rows."""
    name = F.lit(name) if isinstance(name, str) else name
    rows = dest_key(tables, out="_key").select(
        F.concat("_key", F.lit("/"), name).alias("key"), sidecar(tables).alias("body")
    )
    return put_texts(rows, root, "key", "body", spread=True)


def write_converted(df: DataFrame, root: str, one_file_each: bool = True) -> DataFrame | None:
    """Converted sources, one file each at their keys, or as Parquet keyed by ``converted_key``.

    Millions of small files burden any store; the Parquet form suits large workspaces.
    """
    if one_file_each:
        return put_texts(df, root, "converted_key", "after")
    rows = df.select("converted_key", "path", "language", "after")
    rows.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{ASSETS_PREFIX}")
    return None


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled, and line ends inside values are kept."""
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, packed: bool = False) -> None:
    """JSON lines with every key present; ``packed`` by gzip, which Spark's readers undo by the file names."""
    options = {"ignoreNullFields": "false", **(PACKED if packed else {})}
    df.write.mode("overwrite").options(**options).json(path)


def write_inventory(parts: Mapping[str, DataFrame], path: str, as_of: str | None = None) -> None:
    """One JSON folder per part; with ``as_of`` every row carries it as ``generated_at``.

    The download variant passes no clusters and no time.  The parts are written side by side.
    """

    def write(name: str) -> None:
        part = parts[name]
        if as_of is not None:
            part = part.withColumn("generated_at", F.lit(as_of))
        write_json(part, f"{path.rstrip('/')}/{name}")

    with ThreadPoolExecutor(max_workers=len(parts)) as pool:
        list(pool.map(write, parts))


def write_conversion_report(df: DataFrame, path: str, packed: bool = False, **args: Any) -> None:
    """Path, key, outcome, lines and diff of every conversion; the lists stay inside the row.

    It holds each line three times, with JSON around it: many times the sources, unless ``packed``.
    ``args`` go to the diff; sources that don't line up are compared as sequences."""
    args = {"sequence": True, **args}
    apart = args["sequence"] and not args.get("rules", REWRITES)
    ops = op_list(F.col("pairs"), F.col("header_lines"), apart)
    lines = diff_ops(df, **args)
    before, after = (F.filter(F.col("pairs")[side], F.isnotnull) for side in ("l", "r"))
    report = lines.select(
        "path",
        "converted_key",
        *existing(df, "uploaded", "error"),
        before.alias("before_lines"),
        F.concat("header_lines", after).alias("after_lines"),
        ops.alias("diffs"),
    )
    write_json(report, path, packed)
