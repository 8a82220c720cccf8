"""Table data, saved results and file manifests."""

from __future__ import annotations

import re
from itertools import count

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from transhume.session import scratch_dir
from transhume.storage import LISTED, list_folders, resolve


def table_known(spark: SparkSession, ref: str) -> bool:
    """Whether the session knows the table; a name its catalogs cannot hold is just not known."""
    try:
        return spark.catalog.tableExists(ref)
    except AnalysisException:
        return False


def read_table(
    spark: SparkSession, ref: str | None, location: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    """The table by its name, else, also where it can't be read by name, the files at its location."""
    if ref and table_known(spark, ref):
        try:
            return spark.read.table(ref)
        except Exception:
            if not location:
                raise
    if not location:
        raise ValueError(f"table {ref} is not known and has no storage location")
    return spark.read.format(fmt).load(location)


def list_level(
    spark: SparkSession, folders: DataFrame, n_folders: int, must_exist: bool = True
) -> DataFrame:
    """What is directly in the given (path, relative) folders, listed in as many tasks as pay."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = folders.repartition(max(1, min(width, n_folders)), "path")
    return spread.mapInPandas(lambda batches: list_folders(batches, must_exist), LISTED)


def top_folder(spark: SparkSession, location: str) -> DataFrame:
    rows = [(resolve(spark, location), "")]
    return spark.createDataFrame(rows, "path STRING, relative STRING")


def file_manifest(spark: SparkSession, location: str) -> DataFrame:
    """Path, place below the location, length and time of every file, hidden and empty ones too."""
    return walk(spark, top_folder(spark, location))


def walk(spark: SparkSession, starts: DataFrame, must_exist: bool = True) -> DataFrame:
    """Every file below each of the (path, relative) starts, its place beginning with its start's.

    All folders of a level are listed at a time, whatever start they are below, and each level is
    written to the shared scratch folder: a deep tree and many starts are spread over the cluster, and
    none of it is held by the driver.  A start may be a file.  One that is not there is an error, or has
    no files where it need not exist.
    """
    root = scratch_dir(spark, "manifest")
    folders, n_folders = starts.select("path", "relative"), starts.count()
    for level in count():
        # a folder that goes away meanwhile is left out
        checked = must_exist and level == 0
        list_level(spark, folders, n_folders, checked).write.parquet(f"{root}/level={level}")
        found = spark.read.schema(LISTED).parquet(f"{root}/level={level}")
        folders = found.where("is_folder").select("path", "relative")
        n_folders = folders.count()
        if n_folders == 0:
            break
    files = spark.read.schema(LISTED).parquet(f"{root}/level=*").where("NOT is_folder")
    return files.select("path", "relative", "length", "modified_at")


def glob_regex(glob: str) -> str:
    """A file glob (``*``, ``?``, ``[..]``) as a regular expression for one name."""
    parts = re.split(r"(\*|\?|\[!?\]?[^]]*\])", glob)
    wild = {"*": "[^/]*", "?": "[^/]"}
    return "".join(
        wild.get(p) or (p.replace("[!", "[^", 1) if i % 2 else re.sub(r"([^\w/ ])", r"\\\1", p))
        for i, p in enumerate(parts)
    )


def latest_path(spark: SparkSession, folder: str, glob: str) -> str | None:
    """The saved result whose name sorts last, a file or a folder; found without reading any.

    The names come one after the other from the store's own client, as Spark reads the folder, and only
    the last is kept.
    """
    name = re.compile(glob_regex(glob))
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatusIterator(place)
    newest = None
    while listed.hasNext():
        found = listed.next().getPath().getName()
        if name.fullmatch(found) and (newest is None or found > newest):
            newest = found
    return newest and f"{folder.rstrip('/')}/{newest}"


def read_latest(
    spark: SparkSession,
    folder: str,
    glob: str = "migration_results_*.json",
    multi_line: bool = False,
) -> DataFrame:
    """The newest saved result; ``multi_line`` for one written as a pretty-printed file."""
    path = latest_path(spark, folder, glob)
    if path is None:
        raise FileNotFoundError(f"no saved result {glob} in {folder}")
    return spark.read.json(path, multiLine=multi_line)
