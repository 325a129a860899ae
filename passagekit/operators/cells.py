"""Exact nearest neighbours over stored cells: the triangle inequality tells which cells a query need not read.

A bounded sample gives the cells' centres; every vector lies with its nearest centre, and a cell knows its radius.  A
query first reads its nearest cells until these hold k vectors; the k-th distance is a bound, and of the other cells only
those are read whose ball reaches within it.  Centres, radii and numbers of rows are all that the driver holds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import once
from .retrieval import VECTOR_BLOCK, block_scores, top_k

MOST = 1024  # cells
SAMPLE = 16_384  # vectors from which the centres are made
ROUNDS = 8
OTHER = -1  # the cell of vectors that have another number of components than the centres; it is always read


@dataclass
class Cells:
    """rows: (chunk_id, vector, cell, ...); centres, radii and sizes by cell; how many vectors lie in OTHER."""

    rows: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    others: int


def centres_of(sample: np.ndarray, cells: int, seed: int = 1) -> np.ndarray:
    """Centres of a sample by Lloyd's rounds from distinct rows of it."""
    rows = np.unique(sample, axis=0)
    centres = rows[np.random.default_rng(seed).permutation(len(rows))[:cells]]
    for _ in range(ROUNDS):
        own = nearest_centre(sample, centres)[0]
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre and its distance from that."""
    own = np.empty(len(x), np.int64)
    for lo in range(0, len(x), 4096):
        part = x[lo : lo + 4096]
        own[lo : lo + 4096] = ((centres * centres).sum(axis=1) - 2 * part @ centres.T).argmin(axis=1)
    return own, np.sqrt(((x - centres[own]) ** 2).sum(axis=1))


def _matrix(column: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have ``size`` finite components, and these as rows."""
    some = [i for i, v in enumerate(column.to_pylist()) if v is not None and len(v) == size and None not in v]
    rows = np.array([column[i].as_py() for i in some], np.float64).reshape(len(some), size)
    good = np.isfinite(rows).all(axis=1)
    return np.array(some, np.int64)[good], rows[good]


def write_cells(vectors: DataFrame, path: str) -> None:
    """Store vectors (chunk_id, vector, and what else they have) by cells.  Null vectors stay away."""
    spark, held = vectors.sparkSession, vectors.where("vector IS NOT NULL")
    sizes = held.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    size, n = (sizes[0]["size"], sizes[0]["count"]) if sizes else (0, 0)
    picked = held.where(F.size("vector") == size).orderBy(F.xxhash64("chunk_id")).limit(SAMPLE).select("vector")  # bounded
    sample = _matrix(picked.toArrow()["vector"].combine_chunks(), size)[1] if n else np.zeros((0, 0))
    centres = centres_of(sample, int(min(MOST, max(1, np.sqrt(n))))) if len(sample) else sample
    names = held.columns
    place = names.index("vector")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, away = np.full(batch.num_rows, OTHER, np.int64), np.zeros(batch.num_rows)
            if len(centres):
                at, x = _matrix(batch.column(place), size)
                cell[at], away[at] = nearest_centre(x, centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away)], [*names, "cell", "away"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema), "cell int, away double"])
    held.mapInArrow(assign, schema).repartition("cell").write.partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(schema, json.dumps(centres.tolist()))], "schema string, centres string").coalesce(1).write.json(f"{path}/centres")


def read_cells(spark: SparkSession, path: str) -> Cells:
    kept = spark.read.schema("schema string, centres string").json(f"{path}/centres").first()
    rows = spark.read.schema(kept["schema"]).parquet(f"{path}/rows")
    centres = np.array(json.loads(kept["centres"]), np.float64)
    radii, sizes, others = np.zeros(len(centres)), np.zeros(len(centres), np.int64), 0
    for r in rows.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect():  # a row a cell
        if r["cell"] == OTHER:
            others = r["n"]
        else:
            radii[r["cell"]], sizes[r["cell"]] = r["radius"], r["n"]
    return Cells(rows, centres, radii, sizes, others)


def _probes(cells: Cells, k: int, bounded: bool):
    """Rows (query_id, vector[, bound]) to (query_id, vector, cell): the first cells of a query, or all others within its bound."""
    centres, radii, sizes, others = cells.centres, cells.radii, cells.sizes, cells.others  # not the rows: this goes to the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cell = [], []
            own, x = _matrix(batch.column(1), centres.shape[1]) if len(centres) else (np.zeros(0, np.int64), np.zeros((0, 0)))
            bounds = batch.column(2).to_numpy(zero_copy_only=False) if bounded else None
            for i, q in zip(own.tolist(), x, strict=True):
                away = np.sqrt(((centres - q) ** 2).sum(axis=1))
                order = np.argsort(away, kind="stable")
                first = order[: 1 + int(np.searchsorted(np.cumsum(sizes[order]), k))]
                if bounded:
                    least = np.maximum(0, away - radii) ** 2
                    reach = least <= bounds[i] * (1 + 1e-9) + 1e-6  # far above what rounding takes or gives
                    reach[first] = False
                    first = np.flatnonzero(reach & (sizes > 0))
                at += [i] * len(first)
                cell += first.tolist()
            if not bounded and others:
                at += range(batch.num_rows)
                cell += [OTHER] * batch.num_rows
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(cell, pa.int32())], ["query_id", "vector", "cell"])

    return run


def nearest_in_cells(queries: DataFrame, cells: Cells, k: int, keep=once) -> DataFrame:
    """(query_id, chunk_id, distance, rank): the k nearest stored vectors of each query (query_id, vector), as
    ``retrieval.nearest`` gives them, ties by chunk_id.  ``keep`` writes a frame under a name and reads it again."""
    asked = queries.where("vector IS NOT NULL").select("query_id", "vector")
    probe = f"query_id {asked.schema['query_id'].dataType.simpleString()}, vector {asked.schema['vector'].dataType.simpleString()}, cell int"

    def scored(probes: DataFrame, name: str) -> DataFrame:
        probes = keep(probes, f"{name}-probes")
        read = [r["cell"] for r in probes.select("cell").distinct().collect()]  # at most MOST + 1 numbers
        splits = max(1, -(-int(cells.sizes.max(initial=cells.others)) // VECTOR_BLOCK))
        v = cells.rows.where(F.col("cell").isin(read)).select("chunk_id", "vector", "cell", F.size("vector").alias("size"), F.pmod(F.xxhash64("chunk_id"), F.lit(splits)).cast("int").alias("split"))
        q = probes.withColumn("size", F.size("vector")).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
        return keep(top_k(block_scores(v, q, ["cell", "split", "size"], k), k, [F.asc(F.round("distance", 9)), F.asc("chunk_id")]).select("query_id", "chunk_id", "distance"), f"{name}-found")

    first = scored(asked.mapInArrow(_probes(cells, k, False), probe), "first")
    bound = first.groupBy("query_id").agg(F.max("distance").alias("bound"), F.count("*").alias("n"))
    bound = asked.join(bound, "query_id", "left").select("query_id", "vector", F.when(F.col("n") >= k, F.col("bound")).otherwise(float("inf")).alias("bound"))
    more = scored(bound.mapInArrow(_probes(cells, k, True), probe), "more")
    return top_k(first.union(more), k, [F.asc(F.round("distance", 9)), F.asc("chunk_id")])
