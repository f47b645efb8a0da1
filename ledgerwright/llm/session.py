"""Where intermediate results live, and how executors come by this package."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "_ledgerwright_shipped"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Give executors this package once per application; a cluster's workers need no installation. Batches for Python
    are bounded in bytes, as texts may be of any length."""
    context = spark.sparkContext
    if spark.conf.get(_BATCH, None) in (None, "64MB", f"{64 << 20}b"):  # not set by the user
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if getattr(context, _SHIPPED, False):
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="ship")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, f"{package.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(f.relative_to(package.parent)))
    context.addPyFile(target)
    setattr(context, _SHIPPED, True)


def scratch(spark: SparkSession) -> str:
    """A new folder below the one in spark.checkpoint.dir, which all executors share; it goes when the driver ends.

    Where that setting is absent a local session gets a temporary folder; on a cluster it is an error.
    """
    ship(spark)
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = getattr(context, "_ledgerwright_scratch", None)
        if root is None:
            root = tempfile.mkdtemp(prefix="scratch")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
            context._ledgerwright_scratch = root
    path = f"{root.rstrip('/')}/{context.applicationId}-{uuid.uuid4().hex[:12]}"
    where, system = _hadoop(spark, path)
    system.deleteOnExit(where)
    return path


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def durable(df: DataFrame, rows: int | None = None, each: int = 100_000) -> DataFrame:
    """Write a DataFrame to the shared folder and read it again: its lineage ends there,
    and a lost executor costs no more than the tasks that it was running.

    ``rows``: at most so many, where that is known; small tables then get few files, of ``each`` rows or so.
    """
    spark = df.sparkSession
    path = scratch(spark)
    schema = df.schema
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // each)))
    df.write.mode("errorifexists").parquet(path)
    back = spark.read.schema(schema).parquet(path)
    back._ledgerwright_path = path
    return back


def drop(*tables: DataFrame) -> None:
    """Delete what durable() wrote, once nothing that is still to be computed reads it."""
    for df in tables:
        where, system = _hadoop(df.sparkSession, df._ledgerwright_path)
        system.delete(where, True)


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def release() -> None:
    """Give memory that is free back to the machine: Python's workers outlive their tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def freeing(f: Callable, encodes: bool = False) -> Callable:
    """A function for mapInArrow that gives free memory back when its task ends, and before it begins what encoders of an
    earlier stage remember, unless it ``encodes`` itself."""

    def run(batches):
        if not encodes and f"{__package__}.tokens" in sys.modules:
            sys.modules[f"{__package__}.tokens"].forget()
            release()
        yield from f(batches)
        release()

    return run
