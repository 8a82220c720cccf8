"""Large files copied in byte ranges by many tasks, and copies compared range by range.

A file of the manifest is cut into ranges by its length alone.  Every range is a row of its own: it is dealt
to any task, streamed into an object of its own beside the target, and its checksum goes into a small table.
A lost task repeats its ranges only, and so does a later run: what an earlier one left whole is kept, as the
folder of the ranges is named by the source's path, length and time.  A file whose ranges are all there is
put together in order, each range checked once more, and moved to its place.

Files of one range are copied as they are.  An empty manifest gives no rows.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transhume.session import scratch_dir
from transhume.sinks.objects import CHUNK, STATUS, copy_files, safe_key, width, with_scheme
from transhume.storage import open_root, put, resolve

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a range.
PART = 64 * 1024 * 1024
PARTS_FOLDER = ".parts"
RANGE_STATUS = "key STRING, stamp STRING, part INT, n_bytes BIGINT, crc BIGINT, reused BOOLEAN, error STRING"


def ranges(manifest: DataFrame, part_bytes: int = PART) -> DataFrame:
    """key, item, stamp, part, start and size of every range; an empty file has one of no bytes."""
    if part_bytes < 1:
        raise ValueError("a range has a byte at least")
    time: Column = F.col("modified_at") if "modified_at" in manifest.columns else F.lit(None)
    stamp = F.sha2(F.to_json(F.struct("path", "length", time.cast("string").alias("time"))), 256)
    last = F.greatest(F.ceil(F.col("length") / F.lit(part_bytes)), F.lit(1)) - 1
    rows = manifest.select(
        F.col("relative").alias("key"),
        with_scheme(manifest, "path").alias("item"),
        stamp.alias("stamp"),
        "length",
        F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("part"),
    )
    start = F.col("part").cast("long") * part_bytes
    return rows.withColumn("start", start).withColumn(
        "size", F.least(F.lit(part_bytes).cast("long"), F.col("length") - start)
    )


def stream(data: object, size: int, take: Callable[[bytes], object]) -> int:
    """Hand ``size`` bytes on in chunks; gives their checksum."""
    crc, left = 0, size
    while left:
        chunk = data.read(min(CHUNK, left))
        if not chunk:
            raise OSError(f"ends {left} bytes early")
        crc = zlib.crc32(chunk, crc)
        take(chunk)
        left -= len(chunk)
    return crc


def checksum(store: fs.FileSystem, path: str, start: int, size: int) -> int:
    with store.open_input_file(path) as data:
        data.seek(start)
        return stream(data, size, lambda chunk: None)


def part_path(base: str, stamp: str, part: int) -> str:
    return f"{base}/{PARTS_FOLDER}/{stamp}/{part:08d}"


def copy_ranges(rows: DataFrame, root: str) -> DataFrame:
    """Each range as an object of its own below ``root``; gives a status row for each."""

    def one(base: str, store: fs.FileSystem, row: tuple) -> tuple[int, bool]:
        target = part_path(base, row.stamp, row.part)
        if store.get_file_info(target).size == row.size:
            return checksum(store, target, 0, row.size), True
        origin, plain = open_root(row.item)
        with origin.open_input_file(plain) as data:
            data.seek(row.start)
            return put(store, target, lambda out: stream(data, row.size, out.write)), False

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_root(root)
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False):
                head = (row.key, row.stamp, row.part)
                try:
                    safe_key(row.key)
                    crc, reused = one(base, store, row)
                    done.append((*head, row.size, crc, reused, None))
                except Exception as error:
                    done.append((*head, 0, None, False, str(error)))
            yield pd.DataFrame(done, columns=[c.split()[0] for c in RANGE_STATUS.split(", ")]).astype(
                {"crc": "Int64"}
            )

    return rows.mapInPandas(work, RANGE_STATUS)


def assemble(files: DataFrame, root: str) -> DataFrame:
    """Put each file's ranges together, in order; files: key, stamp, length, sums (their checksums)."""

    def one(base: str, store: fs.FileSystem, row: tuple) -> int:
        def fill(out: object) -> int:
            size = 0
            for part, (n_bytes, crc) in enumerate(zip(row.sizes, row.crcs)):
                with store.open_input_stream(part_path(base, row.stamp, part)) as data:
                    if stream(data, n_bytes, out.write) != crc:
                        raise OSError(f"range {part} has changed")
                size += n_bytes
            return size

        size = put(store, f"{base}/{row.key}", fill)
        store.delete_dir(f"{base}/{PARTS_FOLDER}/{row.stamp}")
        return size

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_root(root)
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False):
                try:
                    if row.error is not None:
                        raise OSError(row.error)
                    done.append((row.key, one(base, store, row), True, None))
                except Exception as error:
                    target = store.get_file_info(f"{base}/{row.key}")
                    # a task that runs twice finds the ranges gone and the whole file in its place
                    if row.error is None and target.size == row.length and target.is_file:
                        done.append((row.key, row.length, True, None))
                    else:
                        done.append((row.key, 0, False, str(error)))
            yield pd.DataFrame(done, columns=["key", "n_bytes", "ok", "error"])

    return files.mapInPandas(work, STATUS)


def copy_large(
    manifest: DataFrame, root: str, part_bytes: int = PART, tasks: int | None = None
) -> DataFrame:
    """Copy every file of a manifest to its place below ``root``, long ones by ranges; gives status rows.

    The checksums of a file's ranges go to the task that puts it together: sixteen bytes for each
    ``part_bytes`` of the file.
    """
    spark = manifest.sparkSession
    root = resolve(spark, root)
    small = copy_files(manifest.where(F.col("length") <= part_bytes), root, tasks)
    cut = ranges(manifest.where(F.col("length") > part_bytes), part_bytes)
    log = scratch_dir(spark, "ranges")
    dealt = cut.repartition(tasks or width(manifest), "stamp", "part")
    copy_ranges(dealt, root).write.parquet(log)
    done = spark.read.schema(RANGE_STATUS).parquet(log)
    parts = F.sort_array(F.collect_list(F.struct("part", "n_bytes", "crc")))
    # Two tasks that put one file together would take each other's ranges away: once for each place.
    files = done.groupBy("key", "stamp").agg(
        parts.alias("parts"), F.sum("n_bytes").alias("length"), F.min("error").alias("error")
    )
    files = files.select(
        "key",
        "stamp",
        "length",
        "error",
        F.col("parts.n_bytes").alias("sizes"),
        F.col("parts.crc").alias("crcs"),
    )
    return small.unionByName(assemble(files.repartition(tasks or width(manifest), "key"), root))


def compare_files(
    manifest: DataFrame, root: str, part_bytes: int = PART, tasks: int | None = None
) -> DataFrame:
    """key, n_parts, n_differing and first_differing (an offset) of every file and its copy.

    Both sides of a range are read by one task, so files of any size are spread over the cluster.  A
    range that either side lacks differs; a copy longer than its source differs at its end.
    """
    spark = manifest.sparkSession
    root = resolve(spark, root)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_root(root)
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                try:
                    origin, plain = open_root(row.item)
                    target = f"{base}/{safe_key(row.key)}"
                    mine = checksum(origin, plain, row.start, row.size)
                    same = checksum(store, target, row.start, row.size) == mine
                    if row.start + row.size == row.length:
                        same = same and store.get_file_info(target).size == row.length
                except Exception:
                    same = False
                found.append((row.key, row.start, same))
            yield pd.DataFrame(found, columns=["key", "start", "same"])

    dealt = ranges(manifest, part_bytes).repartition(tasks or width(manifest), "stamp", "part")
    checked = dealt.mapInPandas(work, "key STRING, start BIGINT, same BOOLEAN")
    return checked.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_parts"),
        F.count_if(~F.col("same")).alias("n_differing"),
        F.min(F.when(~F.col("same"), F.col("start"))).alias("first_differing"),
    )
