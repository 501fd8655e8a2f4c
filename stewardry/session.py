"""Session settings and durable cut points."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings every job relies on; all of them can change on a live session."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a hot join key even when that costs one more exchange
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        # of a key repeated in a JSON object the last value counts
        "spark.sql.variant.allowDuplicateKeys": "true",
        # stream state lives on disk and is not bounded by the heap
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the one the cluster names, else (local mode only) a new one."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="stewardry-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the checkpoint folder and continue from there.

    The files survive the loss of executors, and values that depend on where a row
    was placed (positions, partition ids) stay fixed for every later reader. Readers
    fetch only the columns they need, and the planner knows the size.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint root, gone when the application ends."""
    if not _written:
        atexit.register(_remove, _written)
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


_written: list[tuple[SparkSession, str]] = []


@contextmanager
def scratch_removed() -> Iterator[None]:
    """Folders written inside are removed at the end; nothing may read them afterwards."""
    before = len(_written)
    try:
        yield
    finally:
        own = _written[before:]
        del _written[before:]
        _remove(own)


def _remove(folders: list[tuple[SparkSession, str]]) -> None:
    for spark, path in folders:
        context = spark.sparkContext
        if context._jsc is None or context._jvm is None:
            continue
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
    folders.clear()
