"""Reading tables, cutting lineage in the shared folder, and walking Arrow batches."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.session import checkpoint_root

_written: list[tuple[SparkSession, str]] = []


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver did.

    On a cluster the package is installed or sent with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def held(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` written like :func:`written`, and its files removed behind the block: what is made
    of them inside has to be written itself."""
    out = written(df, name)
    own = _written[-1]
    try:
        yield out
    finally:
        _delete(*own)
        _written.remove(own)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read back.

    Lineage ends at files that every executor sees, so a lost executor costs no
    recomputation and values that depend on a row's place stay fixed. The files go when
    the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove)
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove() -> None:
    for spark, path in _written:
        if spark.sparkContext._jvm is None or spark.sparkContext._jsc is None:
            return
        _delete(spark, path)
    _written.clear()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` whose texts hold about ``limit`` bytes; one long text stays whole."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()


def unused(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column is called like that."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def apart(deals: np.ndarray) -> np.ndarray:
    """Different values for equal ones of a batch, whatever their order, so that equal rows go
    to many tasks."""
    order = np.argsort(deals, kind="stable")
    ordered = deals[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    nth = np.arange(len(deals)) - np.repeat(first, np.diff(np.append(first, len(deals))))
    out = np.empty_like(deals)
    out[order] = ordered + 1_000_003 * nth
    return out


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts (null: none), one after another, and where each begins and ends."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) for f in schema], schema=schema
    )
