"""Shared helpers: stage tables in the shared folder, fresh column names, UTF-8 views of Arrow text."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

class _Live(threading.local):
    """Paths of the tables of ``stage_table`` that are still there, oldest first; each thread has its own, as a query runs in one."""

    def __init__(self):
        self.paths: list[str] = []


_LIVE = _Live()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session's ``spark.checkpoint.dir`` or its checkpoint directory names it.

    A session of one machine that names none gets a temporary folder of its own; any other raises ValueError, as a
    machine's own folder would lose the tables of others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_dir.get() if set_dir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        found = tempfile.mkdtemp(prefix="varloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Whether Spark deletes a query's shuffle files as soon as it has ended, rather than when the driver's memory is next collected.
TIDY_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_table(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts the lineage and survives lost executors.

    The shuffle files of the write go when it has ended; nothing reads them after that.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/varloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY_SHUFFLES, "false")
    spark.conf.set(TIDY_SHUFFLES, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(TIDY_SHUFFLES, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.stage_path = path
    _LIVE.paths.append(path)
    return back


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _LIVE.paths:
        _LIVE.paths.remove(path)


def drop_stage(df: DataFrame) -> None:
    """Delete a table of ``stage_table`` that no later plan reads."""
    if path := getattr(df, "stage_path", None):
        _delete(df.sparkSession, path)


def staged() -> int:
    """A mark for ``sweep``: how many stage tables this thread has."""
    return len(_LIVE.paths)


def sweep(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Delete the stage tables that this thread made since ``mark``, but for those that a result still reads."""
    kept = {k.stage_path for k in keep}
    for path in [p for p in _LIVE.paths[mark:] if p not in kept]:
        _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows in an Arrow batch of texts. The default of 10,000 takes a worker's memory with long texts.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Have Spark hand texts to Python workers in batches of ``BATCH_ROWS`` at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def tidy() -> None:
    """Give what a Python worker no longer uses back to the system: Spark keeps workers for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidily(batches):
    """``batches``, tidied up after each."""
    for b in batches:
        yield b
        del b
        tidy()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made different from every column of ``df`` (compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one uint8 array and their n + 1 offsets in it; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "").cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers (splitmix64 finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def chunks(offsets: np.ndarray, most: int = 4 << 20):
    """Ranges of rows holding about ``most`` bytes each; a longer text makes a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j
