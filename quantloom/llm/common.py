"""Shared plumbing: table access, the shared work folder and Arrow column helpers."""

from __future__ import annotations

import ctypes
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_shipped: set[str] = set()
#: Session settings that replace Spark's defaults (given first): whole texts are long, and batches of
#: 10,000 rows or 64 MB take much memory outside the heap of executors and Python workers.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "500"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m")}


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once for each application, and cut Arrow batches of
    the default sizes as BATCHES says."""
    for key, (default, own) in BATCHES.items():
        if spark.conf.get(key, None) == default:
            spark.conf.set(key, own)
    if (app := spark.sparkContext.applicationId) not in _shipped:
        top = Path(__file__).resolve().parents[2]
        target = Path(tempfile.mkdtemp(prefix="quantloom-")) / f"quantloom-{uuid.uuid4().hex}"
        spark.sparkContext.addPyFile(shutil.make_archive(str(target), "zip", top, "quantloom"))
        _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables; the path may be in any store that Spark reads."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder set in code.

    Only a local master may do without: it gets a folder of its own, as driver and tasks are one
    machine. On a cluster a folder that is not shared would lose data, so there its lack is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quantloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """Rows (of a sample bounded in number) in the order of a hash of doc_id, while their text has `most` bytes."""
    upto = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    sizes = rows.withColumn("_upto", upto)
    return sizes.where(F.coalesce(F.col("_upto"), F.lit(0)) <= most).drop("_upto")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/quantloom/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that `stored` wrote, once all that is read from it is stored itself."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(df.inputFiles()[0])).getParent()
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def text_slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about `limit` bytes (one row at least).

    Yields (first row, last row + 1, bytes as uint8, offsets of the rows in them). Null is empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    give_back()


@functools.cache
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda keep: 0


def give_back() -> None:
    """Return freed memory to the machine: Python workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; every machine has it installed."""
    import public_tokenizers

    return public_tokenizers.path(name)
