"""Points and intervals on each key's line, swept in order instead of joined by the key alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL = 4096  # positions of a key that one sweep sees


def within(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, take: list[str], by: str = "source_id") -> DataFrame:
    """Points with ``take`` of the interval [start, end] of their key that holds them; points in none go.

    Intervals of one key must not overlap.  A key's line is cut in cells, an interval stands in each cell that it meets, and
    a cell is one sweep: the last interval that has begun is the only one that may hold a point.  So work grows with rows,
    and a key of very many points is many cells.  Null keys, positions and bounds meet nothing.
    """
    cell = lambda c: F.floor(F.col(c) / CELL).cast("long")
    i = intervals.where(F.col(start) <= F.col(end)).select(by, start, end, *take).withColumn("_cell", F.explode(F.sequence(cell(start), cell(end))))
    opened = i.select(by, "_cell", F.greatest(F.col(start).cast("long"), F.col("_cell") * CELL).alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col(end).cast("long").alias("_end"), *take).alias("_held"))
    met = points.where(F.col(by).isNotNull() & F.col(at).isNotNull())
    met = met.select(by, cell(at).alias("_cell"), F.col(at).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_point"))
    sweep = Window.partitionBy(by, "_cell").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = opened.unionByName(met, allowMissingColumns=True).withColumn("_in", F.last("_held", ignorenulls=True).over(sweep))
    return both.where("_kind = 1 AND _at <= _in._end").select("_point.*", *(f"_in.{c}" for c in take))


def merged(intervals: DataFrame, start: str, end: str, by: str = "source_id") -> DataFrame:
    """The union of each key's intervals as intervals that do not overlap."""
    w = Window.partitionBy(by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = intervals.where(F.col(start) <= F.col(end)).select(by, start, end).distinct()
    own = own.withColumn("_new", F.when(F.col(start) > reach, 1).when(reach.isNull(), 1).otherwise(0)).withColumn("_n", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return own.groupBy(by, "_n").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_n")
