"""Shared storage: where intermediate tables go so that a lost executor costs no results."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds after which a stored table is an occasion to collect the driver's garbage.
FREE_SECONDS = 10.0
_freed = [0.0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent on a local master (tests) a temporary folder is
    chosen once per session, recorded in the same setting and removed when the
    process ends. On any other master the setting must be there: executors don't
    see one another's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="pyrocline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/pyrocline/{label}-{uuid.uuid4().hex}"


def free(spark: SparkSession, seconds: float = 0.0) -> None:
    """Collect the garbage of driver and executors, unless that was done less than ``seconds`` ago.

    Only then does Spark drop broadcast tables and shuffle files that nothing uses, and the
    heaps shrink: an executor's keeps the size that an earlier step needed, beside the Python workers of the next.
    """
    now = time.monotonic()
    if now - _freed[0] < seconds:
        return
    _freed[0] = now
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    executors = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1  # the driver is one; on a local master it is the executor
    if executors > 0:
        # As many tasks as executors: idle ones get one each. Where some are busy, some may get none or two, which costs time alone.
        spark.range(0, executors, 1, executors).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back.

    Cuts the lineage like ``checkpoint()``, in compressed columns.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    free(spark, FREE_SECONDS)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`settle` returned and nothing reads any more."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
            if "/pyrocline/" in file:
                path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
