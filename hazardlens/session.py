"""Session set-up and the shared scratch folder every job writes under."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
#: What has been made below the shared root and not been removed, by application: ("folder", path) or ("table", name).
_MADE: dict[str, list[tuple[str, str]]] = {}


def build_session(app_name: str = "hazardlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; cluster submit options still win for the rest."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # No call-site capture per column while plans are put together.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return pin_utc(builder.getOrCreate())


def pin_utc(spark: SparkSession) -> SparkSession:
    """Day arithmetic and text dates are defined in UTC, whatever the host's zone is."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder, because there the driver and the
    executors are one process; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL_SCRATCH.get(context.applicationId)
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="hazardlens-")
        _LOCAL_SCRATCH[context.applicationId] = root
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/hazardlens/{context.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared root that no other job uses; the innermost ``scratch_scope`` owns it."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(("folder", path))
    return path


def note_table(spark: SparkSession, name: str) -> None:
    """Have a table of the session's catalog dropped with the folders that were made at its time."""
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(("table", name))


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes on leaving what was stored inside: folders of the shared root and catalog tables over them.

    For work that ends with its results written elsewhere. A data frame that reads such a table must not outlive it.
    """
    made = _MADE.setdefault(spark.sparkContext.applicationId, [])
    before = len(made)
    try:
        yield
    finally:
        while len(made) > before:
            discard(spark, *made.pop())


def discard(spark: SparkSession, kind: str, name: str) -> None:
    """Remove a "folder", or a "table" of the session's catalog; nothing happens if it is not there."""
    if kind == "table":
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    else:
        delete_folder(spark, name)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system its scheme names; nothing happens if it is not there."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when the path exists on whatever file system its scheme names."""
    try:
        spark.read.format("binaryFile").load(path)  # has a schema of its own, so nothing is read
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True
