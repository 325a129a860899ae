"""Derived tables and indexes written once a session for each folder of input, and read by all queries after that."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import folder

_WRITTEN: dict[tuple, str] = {}


def _state(spark: SparkSession, d: str, inputs: tuple[str, ...]) -> tuple:
    """What the inputs are now: their bytes and times, so that a changed table is derived again."""
    jvm, out = spark.sparkContext._jvm, []
    for name in inputs:
        path = jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        out.append((files.getContentSummary(path).getLength(), files.getFileStatus(path).getModificationTime()))
    return tuple(out)


def place(spark: SparkSession, d: str, name: str, inputs: tuple[str, ...], write: Callable[[str], None]) -> str:
    """The folder that ``write`` has filled from the inputs of ``d``, in this session."""
    key = (spark.sparkContext.applicationId, d, name, _state(spark, d, inputs))
    if key not in _WRITTEN:
        path = folder(spark, name) + "/data"
        write(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def table(spark: SparkSession, d: str, name: str, inputs: tuple[str, ...], make: Callable[[], DataFrame]) -> DataFrame:
    return spark.read.parquet(place(spark, d, name, inputs, lambda path: make().write.mode("overwrite").parquet(path, compression="zstd")))


def once(df: DataFrame, name: str) -> DataFrame:
    """A small frame written and read again, so that plans that use it more than once make it once."""
    path = folder(df.sparkSession, name) + "/data"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


SMALL = 1_000_000


def broadcast_if_small(written: DataFrame) -> DataFrame:
    """A written table of a few numbers a row: sent to all executors up to SMALL rows, else joined as Spark plans it."""
    return F.broadcast(written) if written.count() <= SMALL else written
