"""File access inside tasks: listing, reading and writing single files of any store.

Spark's file readers skip hidden and empty files and its writers choose their own names, so work
on whole files (a table's log folder, a sidecar at its key) goes through these small helpers.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from itertools import islice
from urllib.parse import unquote

import pandas as pd
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession

# Tasks carry these functions with them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTED = "path STRING, relative STRING, is_folder BOOLEAN, length BIGINT, modified_at TIMESTAMP"
LIST_CHUNK = 10_000
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


# Schemes that name the same store by another driver.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}


def mounts(spark: SparkSession) -> list[tuple[str, str]]:
    """Folders of Hadoop's mount tables (``viewfs``) and the places they stand for, longest first.

    Only Spark knows these tables; the clients used in tasks get the place behind.
    """
    links = spark._jsc.hadoopConfiguration().getPropsWithPrefix("fs.viewfs.mounttable.")
    found = []
    for key in links.keySet():
        table, mark, folder = key.partition(".link./")
        if mark:
            found.append((f"viewfs://{table}/{folder}".rstrip("/"), links.get(key).rstrip("/")))
    return sorted(found, key=lambda link: len(link[0]), reverse=True)


def unmounted(location: str, links: list[tuple[str, str]]) -> str:
    for folder, place in links:
        if location == folder or location.startswith(f"{folder}/"):
            return place + location[len(folder) :]
    return location


def default_store(spark: SparkSession, location: str = "/") -> str:
    """The location on the default file system of the session, with its scheme."""
    place = spark._jvm.org.apache.hadoop.fs.Path(location)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.makeQualified(place).toString().rstrip("/")


def resolve(spark: SparkSession, location: str) -> str:
    """The location with its scheme, as Spark's own readers take it.

    A path without scheme is on the default file system of the session.  Where that is the local disk it
    has to be a folder that all executors share, as it has for Spark's readers and writers.
    """
    if ":/" not in location or "/" in location.partition(":/")[0]:
        location = default_store(spark, location)
    scheme, _, rest = unmounted(location, mounts(spark)).partition(":/")
    return f"{SCHEMES.get(scheme, scheme)}:/{rest}"


def open_root(location: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a URI (file, s3, gs, hdfs, ..)."""
    if location.startswith("file:"):
        return fs.LocalFileSystem(), unquote("/" + location[len("file:") :].lstrip("/"))
    if ":/" not in location:
        raise ValueError(f"{location} has no scheme")
    return fs.FileSystem.from_uri(location)


def entries(store: fs.FileSystem, plain: str, must_exist: bool = True) -> Iterator[tuple]:
    """(path, name, is a folder, length, time) of what is directly in a folder, or of the file itself.

    A folder on a disk is streamed.  A store's client gives it as one list, of small items.
    """
    here = store.get_file_info(plain)
    if here.type == fs.FileType.NotFound:
        if must_exist:
            raise FileNotFoundError(plain)
    elif here.is_file:
        yield here.path, here.base_name, False, here.size, here.mtime
    elif isinstance(store, fs.LocalFileSystem):
        with os.scandir(plain or "/") as found:
            for entry in found:
                yield entry.path, entry.name, *stat_of(entry)
    else:
        for info in store.get_file_info(fs.FileSelector(plain, recursive=False)):
            is_folder = info.type == fs.FileType.Directory
            yield info.path, info.base_name, is_folder, info.size or 0, info.mtime


def stat_of(entry: os.DirEntry) -> tuple:
    """(is a folder, length, time) of a file on a disk; a link to nothing has no time."""
    try:
        stat = entry.stat()
    except FileNotFoundError:
        return False, 0, None
    time = EPOCH + timedelta(microseconds=stat.st_mtime_ns // 1000)
    return entry.is_dir(), 0 if entry.is_dir() else stat.st_size, time


def list_folders(
    batches: Iterator[pd.DataFrame], must_exist: bool = True
) -> Iterator[pd.DataFrame]:
    """One level below each folder: its files and folders with their place below the start."""
    names = ["path", "relative", "is_folder", "length", "modified_at"]
    for batch in batches:
        for location, below in zip(batch["path"], batch["relative"]):
            store, plain = open_root(location)
            plain = plain.rstrip("/")
            if isinstance(store, fs.LocalFileSystem):
                scheme = "file:"
            else:
                scheme = location.rstrip("/").removesuffix(plain)
            found = entries(store, plain, must_exist)
            while some := list(islice(found, LIST_CHUNK)):
                rows = [
                    (scheme + path, f"{below}/{name}".lstrip("/"), *rest)
                    for path, name, *rest in some
                ]
                yield pd.DataFrame(rows, columns=names)


def put(store: fs.FileSystem, target: str, fill: Callable) -> int:
    """Write beside the target, then move there: a task that is lost leaves no half file, and one
    that runs twice leaves a whole one."""
    folder, _, name = target.rpartition("/")
    store.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        size = fill(out)
    store.move(part, target)
    return size
