"""What the training-data operators share: table reading, written intermediate tables, row checks."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session may go without that setting (as in tests); it gets a
    folder of its own, which is then set. A cluster without it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and (held := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        base = held.get()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"loomtext-{os.getpid()}")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: While a table is written: Spark then deletes the shuffle files of that job as soon as it is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: dict[str, SparkSession] = {}


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage, and a lost executor costs no more than the stage
    that was running. Parquet is compressed and columnar, so later readers
    fetch only the columns they use. Operators :func:`forget` the tables that
    nothing reads any more; those that a result still reads go when the
    program ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_forget_all)
    _written[path] = spark
    with_cleanup(spark, lambda: df.write.parquet(path))
    out = spark.read.schema(df.schema).parquet(path)
    out._loomtext_path = path
    return out


def with_cleanup(spark: SparkSession, job: Callable[[], None]) -> None:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        job()
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def forget(*frames: DataFrame) -> None:
    """Delete tables made by :func:`materialise` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_loomtext_path", None)
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _written.pop(path, None)


def _forget_all() -> None:
    for path, spark in list(_written.items()):
        with contextlib.suppress(Exception):  # the session may be gone already, and its folder with it
            _delete(spark, path)


def tidy() -> None:
    """Give memory that a Python worker no longer uses back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that leaves the worker without spare memory."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()

    return outer


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
