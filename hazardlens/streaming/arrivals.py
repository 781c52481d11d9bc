"""Newly arrived vulnerability documents to flat rows, each document taken once.

Which ids are known is keyed streaming state: RocksDB on each executor, its changes in the checkpoint. A batch looks
up its own ids there, so what was stored before is never scanned, however large it has grown.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens import fixed_values as fixed
from hazardlens import schemas
from hazardlens.plans.vulnerabilities import flatten, of_ecosystem
from hazardlens.session import path_exists
from hazardlens.sources.documents import is_json, parsed

#: Ids seen so far are kept in RocksDB; a batch adds only its changes to the checkpoint.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _with_keys(arrivals: DataFrame) -> DataFrame:
    """Documents with their key and version. The text is parsed once; what is not JSON comes back as it is.

    The key is the id. A document without one is its text, and a text that is not JSON counts once per file.
    """
    read = arrivals.where(F.trim("document") != "").select(
        "file", F.xxhash64("document").alias("text_hash"),
        parsed(F.col("document"), schemas.VULNERABILITY_DOCUMENT).alias("_document"))
    readable = is_json()
    key = (F.when(~readable, F.concat(F.lit("file "), F.xxhash64("file", "text_hash").cast("string")))
           .when(F.col("id").isNull(), F.concat(F.lit("text "), F.col("text_hash").cast("string")))
           .otherwise(F.concat(F.lit("id "), F.col("id"))))
    version = F.coalesce("modified", "published", F.lit(""))
    return read.select("file", "text_hash", "_document.*").withColumns({
        "key": key, "version": version, "document": F.when(~readable, F.col("_corrupt_record"))}).drop("file", "_corrupt_record")


def _last_versions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last version of each key; a task has all documents of its keys in the batch, and no others."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    order = pc.sort_indices(table, [("key", "ascending"), ("version", "ascending"), ("text_hash", "ascending")])
    keys = table.column("key").take(order).combine_chunks()
    last = np.ones(len(order), bool)
    if len(order) > 1:
        last[:-1] = np.asarray(pc.not_equal(keys[:-1], keys[1:]))
    yield from table.take(order.filter(pa.array(last))).to_batches(max_chunksize=4096)


def _has_entries() -> Column:
    return F.coalesce(F.exists("affected", of_ecosystem), F.lit(False))


def take_in(spark: SparkSession, documents: str, table: str, checkpoint: str, files_per_batch: int = 1000,
            one_per_file: bool = False, files_written: int = 8) -> list[dict]:
    """Run through everything that arrived in the ``documents`` folder since the last call, then stop.

    A file holds one document per line, or with ``one_per_file`` one document of any layout. The checkpoint
    remembers the files and the ids; ids that an earlier batch stored are left out, as a document may arrive again
    under another file name. Of several versions of an id in one batch the one modified last counts; if it has no
    entry of the ecosystem, the id stays unknown. Texts that are no JSON are kept as they are, once per file
    (``unreadable_texts``). A batch writes a folder of its own and overwrites it when it is tried again, so a
    batch that was cut off leaves no rows behind twice. Returns Spark's progress report of each batch.
    """
    arrivals = (spark.readStream.schema("document string").option("maxFilesPerTrigger", files_per_batch)
                .text(documents, wholetext=one_per_file).select("document", F.col("_metadata.file_path").alias("file")))
    keyed = _with_keys(arrivals).repartition("key")
    latest = keyed.mapInArrow(_last_versions, keyed.schema)
    fresh = latest.where(F.col("document").isNotNull() | _has_entries()).dropDuplicates(["key"])

    def store(batch: DataFrame, number: int) -> None:
        rows = flatten(batch, others=["document"], keep_empty=True)
        (rows.select(*fixed.FLAT_COLUMNS, "document", F.col("document").isNull().alias("readable"))
         .repartition(files_written).write.mode("overwrite").partitionBy("readable").parquet(f"{table}/batch={number}"))

    before = {name: spark.conf.get(name, None) for name in STATE_SETTINGS}
    for name, value in STATE_SETTINGS.items():
        spark.conf.set(name, value)
    try:
        query = (fresh.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    query.awaitTermination()
    return [dict(progress) for progress in query.recentProgress]


def _arrived(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.schema(f"{schemas.VULNERABILITIES}, document string, batch bigint, readable boolean").parquet(table)


def stored_rows(spark: SparkSession, table: str) -> DataFrame | None:
    """All rows taken in so far with the number of their batch, None before the first batch."""
    return _arrived(spark, table).where("readable").drop("document", "readable") if path_exists(spark, table) else None


def unreadable_texts(spark: SparkSession, table: str) -> DataFrame:
    """The texts that no batch could read, with the number of their batch."""
    return _arrived(spark, table).where("not readable").select("document", "batch")
