"""Folders for what a job writes besides its result."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def home(spark: SparkSession) -> str:
    """The application's folder under spark.checkpoint.dir, which all executors share.

    Where that is unset, as in tests, a local master gets a temporary folder; any other raises ValueError, since its
    executors would each write to a disk of their own.
    """
    base, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="lexaline-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        base = _own[app]
    return f"{base.rstrip('/')}/lexaline-{app}"


def work_dir(spark: SparkSession) -> str:
    """A new folder in the application's."""
    return f"{home(spark)}/{uuid.uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder; results that read it must be written before."""
    delete(spark, home(spark))
