"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of a batch of texts on its way to Python.
BATCH_ROWS, BATCH_BYTES = 2048, "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark whatever store it lies in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    A temporary one is used only where none is named and Spark runs in one process, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tables-")
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared folder, and read it.

    Unlike a checkpoint of the RDD, the rows are computed once.  A lost executor costs nothing:
    what is read again is on the shared store.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def small_batches(df: DataFrame) -> DataFrame:
    """Texts go to Python in batches of a few MB, whatever the length of a text.

    Sets the session's Arrow limits unless they are already lower.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


@functools.cache
def _trim() -> Callable[[int], int] | None:
    """The C library's malloc_trim, where it has one."""
    name = ctypes.util.find_library("c")
    return getattr(ctypes.CDLL(name), "malloc_trim", None) if name else None


def release_memory() -> None:
    """Give back what a task's arrays took: workers stay, and serve other stages."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def released(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function over batches, which gives memory back as its task ends."""

    @functools.wraps(function)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            release_memory()

    return run
