"""Helpers that several operators use: the shared folder, written tables, checked broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most this many rows of a few integers are broadcast; beyond it, joins shuffle.
BROADCAST_ROWS = 1_000_000

_kept: dict[tuple, Any] = {}


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """What a worker process keeps from task to task: one thing, so that the caches of several stages don't add up."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


#: Bytes of an Arrow batch that an operator gets, so that long texts don't add up to large batches: the JVM keeps chunks
#: of 16 MB for each thread that writes batches, and a worker's arrays are several times a batch.
BATCH_BYTES = 2 << 20


def arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema, keeps: bool = False, trims: bool = False) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of BATCH_BYTES at most (unless the session has a limit of its own). In the
    worker, what other operators kept goes first (all of it unless run keeps something itself), and freed memory goes back
    to the system at the end; with trims after every batch, for operators whose arrays are many times a batch."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _kept.clear()
        try:
            for out in run(batches):
                yield out
                if trims:
                    give_back()
        finally:
            give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(go, schema)


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # the default
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries
        pass


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A batch of a given schema from arrays or lists: 64-bit ids stay whole beside nulls."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_table(spark: SparkSession, data: pa.Table) -> DataFrame:
    """A small table of the driver's as a local relation: one made of a list of rows is an RDD that goes through Python, for
    which each executor starts another daemon, with workers of its own, that stays as long as the executor does."""
    return spark.createDataFrame(data)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where it is unset and
    driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='strandlog-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandlog_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by written(), once nothing reads it any more."""
    path = getattr(df, "_strandlog_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def checked_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint a broadcast only if df, narrow and already computed, has at most BROADCAST_ROWS rows."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df
