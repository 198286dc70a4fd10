"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import time
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from ``spark.checkpoint.dir``.

    Only where the session names none (tests, a laptop) is it a folder of the
    warehouse, which is shared by definition.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_millrace").rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what it holds goes when the driver ends."""
    root = f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_remove_root, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


_ROOTS: set[str] = set()


def store_of(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder that driver and executors share, and the folder's name in it."""
    if "://" not in path and not path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), path
    return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def remove(spark: SparkSession, path: str) -> None:
    """Remove a path of any store that Spark can write to."""
    gateway = spark.sparkContext._jvm
    target = gateway.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_root(root: str) -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and not spark.sparkContext._jsc.sc().isStopped():
            remove(spark, root)
            return
    except Exception:  # noqa: BLE001  the session is on its way out
        pass
    if root.startswith(("file:", "/")):
        shutil.rmtree(re.sub("^file:/*", "/", root), ignore_errors=True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write *df* to the shared folder and read it back.

    Lineage ends at the written table, so a lost executor costs a re-read and
    not a recomputation; joins of two such tables have a plain exchange on both
    sides, which lets adaptive execution split skewed keys.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._staged_path = path
    return found


def released(*tables: DataFrame) -> None:
    """Remove tables of :func:`staged` that nothing will read again."""
    for table in tables:
        remove(table.sparkSession, table._staged_path)


_RELEASE_SECONDS = 0.3


def swept(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished queries.

    Spark removes them when the driver has collected what referred to them, which a driver
    with memory to spare may do much later than executors run out of disk.
    """
    for _ in range(2):  # the first collection frees what refers to the second's
        gc.collect()
        time.sleep(_RELEASE_SECONDS)  # until the driver's JVM has heard what Python let go of
        spark.sparkContext._jvm.System.gc()
