"""What the operators of this subpackage share: staging in the shared folder, and column naming."""

from __future__ import annotations

import ctypes
import pickle
import re
import sys
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, read from the session.

    Where it is missing and the master is local, as in tests, a folder beside the session's warehouse stands in.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quillmark"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quillmark/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` into the shared folder and reads it back, which cuts the lineage.

    What is read survives the loss of any executor; unlike ``checkpoint()`` it is computed once and stays columnar.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def attach(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns`` at its end; a column of the input with such a name (in any case) gives way."""
    taken = {c.lower() for c in columns}
    return df.select(*[F.col(quoted(c)) for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in columns.items()])


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it until no column of ``df`` is called so."""
    names = {c.lower() for c in df.columns}
    while wanted.lower() in names:
        wanted = "_" + wanted
    return wanted


#: No value of more bytes is broadcast.
MOST_SHIPPED = 512 << 20


def ship(spark: SparkSession, value):
    """Broadcasts a value by value, classes of this package included; ``received`` opens it. What is too large for every
    task to hold raises an error."""
    data = cloudpickle.dumps(value)
    if len(data) > MOST_SHIPPED:
        raise ValueError(f"a broadcast of {len(data)} bytes; {MOST_SHIPPED} at most")
    return spark.sparkContext.broadcast(data)


def received(shipped):
    return pickle.loads(shipped.value)


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, for what is costly to build and the same for all tasks."""
    return sys.modules.setdefault("_quillmark_worker", types.ModuleType("_quillmark_worker")).__dict__


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python by 4 MiB, unless the session says otherwise: buffers of tasks and workers stay at the size of
    the largest batch, and 10,000 rows of long texts make large ones. No result depends on it."""
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, 4 << 20)


def drained(batches: Iterator) -> Iterator:
    """``batches``; at their end a worker's free memory goes back to the system, since it stays idle beside others."""
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
