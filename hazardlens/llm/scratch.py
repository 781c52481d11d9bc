"""Intermediate tables in the shared folder: they cut lineage and outlive executors."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from hazardlens.session import discard, new_folder, note_table

#: Shuffle files go as soon as the table that they were for is written.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows go to Python in batches of so many bytes at most (a longer row is a batch of its own), however long texts are.
BATCH_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
#: What the innermost ``stored_alone`` of this thread deletes in the end; other threads have their own.
_PASSING: ContextVar[list[tuple[str, str]] | None] = ContextVar("passing", default=None)


def _passing(kind: str, name: str) -> str:
    if (made := _PASSING.get()) is not None:
        made.append((kind, name))
    return name


def _freeing(spark: SparkSession, write: Callable[[], None]) -> None:
    wanted = {FREE_SHUFFLES: "true", **BATCH_BYTES}
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        write()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def stored(frame: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write the frame below ``spark.checkpoint.dir`` and read it back."""
    return stored_at(frame, label, partition_by)[0]


def stored_alone(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """As ``stored`` of the frame that ``make`` returns; what ``make`` itself stored on the way to it is deleted."""
    path, made = _passing("folder", new_folder(spark, label)), []
    outer = _PASSING.set(made)
    try:
        frame = make()
        _freeing(spark, lambda: frame.select("*").write.parquet(path))
    finally:
        _PASSING.reset(outer)
        for one in reversed(made):
            discard(spark, *one)
    return spark.read.schema(frame.schema).parquet(path)


def stored_at(frame: DataFrame, label: str, partition_by: list[str] | None = None) -> tuple[DataFrame, Callable[..., None]]:
    """As ``stored``, with a function that empties the table, or one folder of it, once nothing reads that any more."""
    spark = frame.sparkSession
    path = _passing("folder", new_folder(spark, label))
    # The setting counts for data frames made under it.
    _freeing(spark, lambda: frame.select("*").write.partitionBy(*(partition_by or [])).parquet(path))

    def release(part: str = "") -> None:
        left = frame.drop(*(partition_by or [])).schema if part else frame.schema
        spark.createDataFrame([], left).write.mode("overwrite").parquet(f"{path}/{part}" if part else path)

    return spark.read.schema(frame.schema).parquet(path), release


def bucketed(frame: DataFrame, label: str, key: str) -> DataFrame:
    """As ``stored``, in buckets of the key: joins on it, however many, shuffle their other side only."""
    spark = frame.sparkSession
    path = _passing("folder", new_folder(spark, label))
    name = path.rpartition("/")[2].replace("-", "_")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _freeing(spark, lambda: frame.repartition(parts, key).write.bucketBy(parts, key).sortBy(key)
             .option("path", path).format("parquet").saveAsTable(name))
    note_table(spark, _passing("table", name))
    return spark.table(name)


def free_names(frame: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as it takes to be none of the frame's columns."""
    taken = {column.lower() for column in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
