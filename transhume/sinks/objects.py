"""Files written one by one at keys of their own: raw copies, sidecars, converted sources.

Spark's writers name their files themselves, so these run as Arrow-batched tasks that put each
object below the root and report what became of it.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transhume.storage import default_store, mounts, open_root, put, resolve

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATUS = "key STRING, n_bytes BIGINT, ok BOOLEAN, error STRING"
CHUNK = 8 * 1024 * 1024
# Objects read as texts that go on together.
TEXTS_AT_ONCE = 256


def safe_key(key: str) -> str:
    if not key or ".." in key.split("/"):
        raise ValueError("key leaves the root")
    return key


def each_row(batches: Iterator[pd.DataFrame], work: Callable) -> Iterator[pd.DataFrame]:
    """Status rows of ``work`` (key, item -> bytes written); one failure stops no other item."""
    for batch in batches:
        rows = []
        for key, item in zip(batch["key"], batch["item"]):
            try:
                rows.append((key, work(safe_key(key), item), True, None))
            except Exception as error:
                rows.append((key, 0, False, str(error)))
        yield pd.DataFrame(rows, columns=["key", "n_bytes", "ok", "error"])


def width(df: DataFrame) -> int:
    """Shuffle width of the session, as a fixed number so that small rows are not drawn together."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_scheme(df: DataFrame, col: str) -> Column:
    """The address with a scheme; one without is on the session's default file system."""
    spark = df.sparkSession
    path = F.when(F.contains(F.col(col), F.lit(":/")), F.col(col))
    path = F.coalesce(path, F.concat(F.lit(default_store(spark)), F.col(col)))
    out = path
    for folder, place in reversed(mounts(spark)):
        below = F.substr(path, F.lit(len(folder) + 1))
        inside = (path == folder) | F.startswith(path, F.lit(f"{folder}/"))
        out = F.when(inside, F.concat(F.lit(place), below)).otherwise(out)
    return out


def put_texts(
    df: DataFrame, root: str, key: str, body: str, spread: bool = False
) -> DataFrame:
    """Write the ``body`` text of every row at ``<root>/<key>``; gives status rows.

    The time goes into opening files, so ``spread`` deals small rows out over all tasks first.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_root(root)

        def one(name: str, text: str) -> int:
            return put(store, f"{base}/{name}", lambda out: out.write(text.encode("utf-8")))

        return each_row(batches, one)

    root = resolve(df.sparkSession, root)
    rows = df.select(F.col(key).alias("key"), F.col(body).alias("item"))
    if spread:
        rows = rows.repartition(width(df), "key")
    return rows.mapInPandas(write, STATUS)


def copy_files(manifest: DataFrame, root: str, tasks: int | None = None) -> DataFrame:
    """Copy every file of a manifest to its place below ``root``; gives status rows.

    Files are streamed in chunks, so their size is not bound by memory.  They are dealt out over
    the tasks first, since a listing holds many files in few partitions.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_root(root)

        def one(name: str, path: str) -> int:
            origin, plain = open_root(path)
            with origin.open_input_stream(plain) as data:

                def fill(out: object) -> int:
                    size = 0
                    while chunk := data.read(CHUNK):
                        size += out.write(chunk)
                    return size

                return put(store, f"{base}/{name}", fill)

        return each_row(batches, one)

    root = resolve(manifest.sparkSession, root)
    rows = manifest.select(F.col("relative").alias("key"), with_scheme(manifest, "path").alias("item"))
    return rows.repartition(tasks or width(manifest), "item").mapInPandas(write, STATUS)


def get_texts(keys: DataFrame, root: str, key: str = "key", tasks: int | None = None) -> DataFrame:
    """key and text of the objects at the given keys below ``root``, null where there is none.

    They are read by the keys that a writer reported, in tasks, and not listed.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_root(root)

        def text(name: str) -> str | None:
            try:
                with store.open_input_stream(f"{base}/{safe_key(name)}") as data:
                    return data.read().decode("utf-8")
            except (FileNotFoundError, ValueError):
                return None

        for batch in batches:
            for start in range(0, len(batch), TEXTS_AT_ONCE):
                names = batch["key"][start : start + TEXTS_AT_ONCE]
                yield pd.DataFrame({"key": names, "text": [text(name) for name in names]})

    root = resolve(keys.sparkSession, root)
    rows = keys.select(F.col(key).alias("key")).repartition(tasks or width(keys), "key")
    return rows.mapInPandas(read, "key STRING, text STRING")
