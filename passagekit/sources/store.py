"""Sinks and document stores: a source's rows replaced, JSON documents with bad ones left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def replace_partitions(df: DataFrame, path: str, key: str = "source_id") -> None:
    """Write rows so that those of each key in df replace what the table had; other keys stay; an empty df changes nothing.

    Rows are gathered by key, and a key of very many rows is split over several tasks and files.
    """
    df.hint("rebalance", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def clear_partition(spark: SparkSession, path: str, key: str, value: str) -> None:
    """Drop the rows of one key: its folder goes, others are not touched; a key that is not there changes nothing."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{key}={value}")
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def read_documents(spark: SparkSession, path: str, schema: StructType | str, key: str) -> DataFrame:
    """JSON documents, one a line; those that do not parse or lack their key are left out."""
    bad = "_corrupt_record"
    full = f"{schema}, {bad} string" if isinstance(schema, str) else StructType([*schema.fields]).add(bad, "string")
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path)
    return rows.where(F.col(bad).isNull() & F.col(key).isNotNull()).drop(bad)


def write_documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str, text: str = "text", by: str = "list_id") -> None:
    """Finished texts as files, a folder a list."""
    df.select(by, F.col(text).alias("value")).write.mode("overwrite").partitionBy(by).text(path)
