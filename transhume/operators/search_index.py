"""A stored index for repeated searches: postings of q-grams, verified on the rows they lead to.

``build`` writes the rows once, dealt to folders by number, and for every row the distinct character runs of
length 1 to Q of its searched fields, dealt to folders by the run's checksum and sorted within them.  ``search``
reads the folders of the text's own runs, keeps the rows that have all of them, and tests only these as
``filters.search`` does.  Texts shorter than Q are runs themselves.  Rows are numbered when they are written, so
repeated rows stay apart.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from transhume.operators import filters

Q = 3
FOLDERS = 64  # that runs, and rows, are dealt to
SPREAD = 8  # tasks that write one folder: a run of every row is no single task's work
RUNS = "run STRING, id LONG, folder INT"
COLS = ("path", "name", "owner")


def runs(text: Column, size: int) -> Column:
    """All runs of so many characters; none for null."""
    found = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))


def folder_of(run: Column) -> Column:
    return (F.crc32(F.encode(run, "utf-8")) % FOLDERS).cast("int")


def row_folder(number: Column) -> Column:
    return F.pmod(F.xxhash64(number), F.lit(FOLDERS)).cast("int")


def _stored_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    kept = StructType().add("id", "long").add("row", schema).add("folder", "integer")
    return spark.read.schema(kept).parquet(f"{path}/rows")


def build(df: DataFrame, path: str, cols: Sequence[str] = COLS) -> None:
    """Write rows and postings of the fields below a new folder ``path``.

    A field is held with its runs, so this is for the names and paths of a listing, not for whole sources.
    """
    whole = F.struct(*[F.col(f"`{name}`") for name in df.columns]).alias("row")
    number = F.monotonically_increasing_id()
    rows = df.select(number.alias("id"), whole)
    rows = rows.withColumn("folder", row_folder(F.col("id")))
    rows.repartition("folder").write.partitionBy("folder").parquet(f"{path}/rows")
    stored = _stored_rows(df.sparkSession, path, df.schema)
    parts = [runs(F.lower(F.col(f"row.`{name}`")), size) for name in cols for size in range(1, Q + 1)]
    postings = stored.select(F.explode(F.array_distinct(F.concat(*parts))).alias("run"), "id")
    postings = postings.withColumn("folder", folder_of(F.col("run")))
    dealt = postings.repartition("folder", F.pmod("id", F.lit(SPREAD))).sortWithinPartitions("folder", "run")
    dealt.write.partitionBy("folder").parquet(f"{path}/postings")


def candidates(spark: SparkSession, path: str, text: str) -> DataFrame:
    """Numbers of the rows that have every run of the text; reads the folders of these runs only."""
    size = min(Q, len(text))
    wanted = sorted({text[i : i + size] for i in range(len(text) - size + 1)})
    folders = sorted({zlib.crc32(run.encode("utf-8")) % FOLDERS for run in wanted})
    postings = spark.read.schema(RUNS).parquet(f"{path}/postings")
    hits = postings.where(F.col("folder").isin(folders) & F.col("run").isin(wanted))
    return hits.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("id")


def search(spark: SparkSession, path: str, query: str, schema: StructType, cols: Sequence[str] = COLS) -> DataFrame:
    """The rows of ``filters.search`` over the indexed rows, whose schema is ``schema``.

    ``cols`` are those the index was built with, or some of them.  No query gives all rows.
    """
    rows = _stored_rows(spark, path, schema)
    if not query:
        return rows.select("row.*")
    found = candidates(spark, path, query.lower()).withColumn("folder", row_folder(F.col("id")))
    return filters.search(rows.join(found, ["id", "folder"]).select("row.*"), query, cols)
