"""Files that tasks write and read themselves, on the storage that Spark's paths name."""

from __future__ import annotations

from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import SparkSession

#: Schemes of Hadoop connectors and the names that pyarrow has for the same storage; all others are alike.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def full_path(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme; one without is on Spark's default file system, on whatever machine a task runs."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return place.makeQualified(store.getUri(), store.getWorkingDirectory()).toString()


def task_uri(path: str) -> str:
    """A full path as pyarrow wants it."""
    scheme, _, rest = path.partition(":")
    return f"{SCHEMES.get(scheme, scheme)}:{quote(rest, safe='/@:')}"


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a full path and the name there. Keys of object stores come from the machine's own settings."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(task_uri(path))
