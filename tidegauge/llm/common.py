"""What the operators share: the folder that all executors see, tables written there, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of a fresh folder below spark.checkpoint.dir; where that is unset (tests), one is set here."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        own = tempfile.mkdtemp(prefix="llm-", dir=_made("/tmp/checkpoints"))
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = "file://" + own
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + root
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def _made(path: str) -> str:
    os.makedirs(path, exist_ok=True)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and a lost executor costs nothing."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    free_shuffles(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables on which nothing depends any more: what was made of them is itself written."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go when the driver collects its garbage; disks fill up if that is late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: What this process keeps from one task to the next: the tables of one operator at most.
_KEPT: dict[Hashable, Any] = {}
_TRIM, _OPTION = (getattr(ctypes.CDLL(None), name, None) for name in ("malloc_trim", "mallopt"))
if _OPTION:
    _OPTION(-3, 4 << 20)  # arrays above 4 MB are mapped by themselves, so that the system has them back when they are freed


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """An object that stays in a worker while tasks with the same key follow; another key's object goes first."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def keep_only(key: Hashable) -> None:
    if key not in _KEPT:
        _KEPT.clear()


def give_back() -> None:
    """Free memory of this process goes back to the system; workers are reused, and executors count them all."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], key: Hashable = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that begins without another operator's tables and gives its memory back at the task's end."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(key)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def file_system(uri: str):
    """pyarrow file system and path of a folder's URI; file: needs no library."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the column's values take about `most` bytes in each; a longer value stands alone."""
    for batch in batches:
        at, total = 0, 0
        sizes = pc.binary_length(batch.column(column)).to_pylist() if batch.num_rows else []
        for i, n in enumerate(sizes):
            n = (n or 0) + 64
            if total and total + n > most:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        if at < batch.num_rows:
            yield batch.slice(at)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a thousand rows bound what Python workers and the JVM hold for them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blob_lists(values: list[bytes], item: pa.DataType, width: int) -> pa.Array:
    """Arrow lists of fixed-width items, one per bytes value."""
    import numpy as np

    offsets = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(v) // width for v in values], out=offsets[1:])
    flat = pa.Array.from_buffers(item, int(offsets[-1]), [None, pa.py_buffer(b"".join(values))])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat)
