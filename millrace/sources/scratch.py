"""Where queries put files that they read again: streams, logs, written tables."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import SparkSession


def _remove(folder: str) -> None:
    """Delete a folder of a shared store at the end; a driver that is killed leaves it."""
    if jvm := SparkContext._jvm:
        with contextlib.suppress(Py4JError, OSError):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, gone when Python ends; a local one only where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    own = f"{name}-{uuid.uuid4().hex}"
    if named:
        folder = f"{named.rstrip('/')}/millrace/{own}"
        atexit.register(_remove, folder)
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{tempfile.gettempdir()}/millrace-scratch/{own}"
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"
