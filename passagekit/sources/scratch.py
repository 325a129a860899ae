"""Folders that every executor sees, for tables between jobs and checkpoints of streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}  # folders of our own, by application


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of our own where that is unset and all tasks run in this process's machine."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="passagekit-")
    return _OWN[app]


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under the root, with its full address; it goes with the driver's JVM."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(target)
    files.deleteOnExit(target)
    address = files.makeQualified(target).toString()
    return "file://" + address[5:] if address.startswith("file:/") and not address.startswith("file://") else address
