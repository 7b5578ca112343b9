"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.session import ship

#: White space that separates words, everywhere in this package: blank and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset (tests on one machine), a folder of its own is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracemill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def trim() -> None:
    """Gives memory that a worker has freed back to the system: workers outlive their tasks, and share a machine."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


_kept: dict[str, dict] = {}


def kept(name: str) -> dict:
    """A table that a worker keeps between tasks of the operator of that name; tasks of others drop it."""
    return _kept.setdefault(name, {})


def forget(but: str | None = None) -> None:
    """Drops what other operators keep."""
    found = [table for name, table in _kept.items() if name != but and table]
    for table in found:
        table.clear()
    if found:
        trim()


def lean(run, keeps: str | None = None):
    """A function of batches that drops what operators but `keeps` have kept, and trims when it ends."""

    def wrapped(batches):
        forget(keeps)
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def lean_group(run):
    """A function of a group's table that trims when it ends."""

    def wrapped(table: pa.Table) -> pa.Table:
        forget()
        try:
            return run(table)
        finally:
            trim()

    return wrapped


def prepare(spark: SparkSession) -> None:
    """Sends the package, and bounds the Arrow batches, so that a worker holds a few MB of texts at a time."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracemill/{name}-{uuid.uuid4().hex}"
    # What is now written needs its shuffle files no more: Spark deletes them when the write ends.
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._tracemill_path = path
    return back


def release(*tables: DataFrame) -> None:
    """Deletes materialised tables that no later step reads."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._tracemill_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of keys that may be sent to all executors; each is a few numbers, so a few MB in all.
SMALL = 100_000


def small(keys: DataFrame) -> DataFrame:
    """A written table of keys, marked for broadcast if its rows, now counted, are at most SMALL; else joined by shuffle."""
    return F.broadcast(keys) if keys.count() <= SMALL else keys


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
