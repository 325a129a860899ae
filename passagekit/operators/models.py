"""Seam for models that answer prompts: any function of a list of prompts runs in the tasks, failures are rows, not errors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import parse_grade


def answered(df: DataFrame, prompt: str, call: Callable[[list[str]], list[str]], attempts: int = 3) -> DataFrame:
    """df with answer and error.  ``call`` gets the prompts of a batch; those of a batch that fails are asked one by one,
    up to ``attempts`` times each.  A null prompt has neither answer nor error."""
    place = df.columns.index(prompt)

    def ask(text: str) -> tuple[str | None, str | None]:
        error = None
        for _ in range(attempts):
            try:
                return call([text])[0], None
            except Exception as e:  # noqa: BLE001 - whatever a model raises becomes the row's error
                error = f"{type(e).__name__}: {e}"
        return None, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            asked = [t for t in texts if t is not None]
            try:
                given = [(a, None) for a in call(asked)] if asked else []
            except Exception:  # noqa: BLE001
                given = [ask(t) for t in asked]
            one = iter(given)
            rows = [next(one) if t is not None else (None, None) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in rows], pa.string()), pa.array([e for _, e in rows], pa.string())], [*batch.schema.names, "answer", "error"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("answer", StringType()), StructField("error", StringType())]))


def graded(df: DataFrame, prompt: str, call: Callable[[list[str]], list[str]]) -> DataFrame:
    """df with score: the first of two answers that holds one from 1 to 5, else null."""
    first = answered(df, prompt, call).withColumnRenamed("answer", "_a").drop("error")
    again = first.withColumn("_again", F.when(parse_grade(F.col("_a")).isNull(), F.col(prompt)))
    both = answered(again, "_again", call)
    return both.withColumn("score", F.coalesce(parse_grade(F.col("_a")), parse_grade(F.col("answer")))).drop("_a", "_again", "answer", "error")
