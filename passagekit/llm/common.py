"""Shared folder, intermediate tables and Arrow helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import folder


class Scratch:
    """Tables that cut lineage: each is written under one folder of the shared root and reread.

    The files outlive lost executors; the folder goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, folder(spark, name)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def folder(self, name: str) -> str:
        """An empty folder beside the tables, for files that tasks write by themselves."""
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
        return f"{self.path}/{name}"

    def drop(self, name: str) -> None:
        """Remove a table that no later step reads, or such a folder."""
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


SMALL = 1_000_000


def broadcast_if_small(table: DataFrame) -> DataFrame:
    """A written table of a few numbers a row: sent to all executors up to SMALL rows (tens of MB), else joined as Spark
    plans it."""
    return F.broadcast(table) if table.count() <= SMALL else table


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow for a function of one batch; fn may yield any number of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``limit`` bytes, so that numpy work on whole parts stays bounded.

    A single longer text makes a part of its own; no text is cut.
    """
    col = batch.column(batch.schema.get_field_index(column))
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(size):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def clean(text: str = "text", ident: str = "doc_id") -> list:
    """The two columns most operators read: the id as long, the text with null as empty."""
    return [F.col(ident).cast("long").alias(ident), F.coalesce(F.col(text), F.lit("")).alias(text)]
