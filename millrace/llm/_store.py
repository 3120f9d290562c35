"""Where intermediate tables of multi-step operators live.

A step that several later steps read is written once, as Parquet, under the
folder the cluster names in ``spark.checkpoint.dir``: that cuts the lineage, and
a lost executor costs only the tasks it was running. A local folder is used only
where the setting is absent and the master is local, as in tests. Operators drop
tables that they have done with; those that a result still reads go when Python ends.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def base_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{_own_dir()}"


def _own_dir() -> str:
    return f"{tempfile.gettempdir()}/millrace-scratch"


def _remove(root: str) -> None:
    """Delete a folder at the end; a driver that is killed leaves it."""
    if root.startswith(f"file://{_own_dir()}"):
        shutil.rmtree(root.removeprefix("file://"), ignore_errors=True)
    elif jvm := SparkContext._jvm:
        with contextlib.suppress(Py4JError, OSError):
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


class Scratch:
    """Tables of one operator call, each under its own name."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.root = f"{base_dir(spark)}/millrace/{operator}-{uuid.uuid4().hex}"
        atexit.register(_remove, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back; the plan behind it is gone afterwards."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let Spark's cleaner delete the shuffle files of steps whose results are kept; give memory that Python has freed back to the system, where it can."""
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        self.spark.sparkContext._jvm.System.gc()
