"""Approximate nearest neighbours by inner product along shifted Hilbert curves.

Each curve orders randomly rotated, projected and shifted vectors by their Hilbert key; Spark range-partitions the keys
and numbers the vectors along each curve.  A query's candidates are the vectors within ``window`` places of it on any
curve; they are re-ranked by their exact inner products.  Equal vectors are one point, so a frequent vector fills no
window, and its smallest ids are listed when results are written out.

Long vectors must not crowd the others: vectors of like length make a band, each band has curves of its own on which
only directions count, and a query is looked up in every band.

How wide a window must be depends on the table: sampled queries are answered by brute force, and the window is widened
until it holds the wanted share of their true neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, map_batches, partitions

CURVES = 32
WINDOW = 768  # at least
RECALL = 0.95  # share of the sampled queries' true neighbours that the window must hold
SAMPLE = 256  # queries answered by brute force: the documented bound of the sample
CELL = 8192  # places of a curve that are ranked together, at most
DIMENSIONS = 16
BITS = 3


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer points, rows of x below 2**bits, along the Hilbert curve of that many dimensions."""
    axes = [c.astype(np.uint64) for c in x.T]
    for b in range(bits - 1, 0, -1):
        top, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i, own in enumerate(axes):
            turned = (own & top) != 0
            if i == 0:
                axes[0] = np.where(turned, own ^ low, own)
            else:
                swap = np.where(turned, np.uint64(0), (axes[0] ^ own) & low)
                axes[0] = np.where(turned, axes[0] ^ low, axes[0] ^ swap)
                axes[i] = own ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros_like(axes[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where((axes[-1] & np.uint64(1 << b)) != 0, flip ^ np.uint64((1 << b) - 1), flip)
    key = np.zeros_like(axes[0])
    for b in range(bits - 1, -1, -1):
        for own in axes:
            key = key << np.uint64(1) | ((own ^ flip) >> np.uint64(b)) & np.uint64(1)
    return key.view(np.int64)


def curve_keys(x: np.ndarray, curve: int, seed: int = 9) -> np.ndarray:
    """Keys of unit vectors on one curve: a random rotation, the first coordinates, a random shift, a grid."""
    rng = np.random.default_rng([seed, curve])
    width = x.shape[1]
    dims = min(DIMENSIONS, width)
    rotation = np.linalg.qr(rng.standard_normal((width, width)))[0][:, :dims]
    place = (x @ rotation) * np.sqrt(width) / 16 + 0.25 + rng.uniform(0, 0.5, dims)
    return hilbert_keys((np.clip(place, 0, 1 - 1e-9) * (1 << BITS)).astype(np.int64), BITS)


def _numbers(batch: pa.RecordBatch, name: str, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(name)).to_pylist()), dtype).reshape(batch.num_rows, -1).astype(np.float64)


def _distinct(dtype: str, least: int):
    """(vec_id, embedding) of valid vectors -> each distinct vector of a task once, with its smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}

        def give() -> Iterator[pa.RecordBatch]:
            raw = list(seen)
            d1, d2 = _digests(raw)
            norms = [float(np.linalg.norm(np.frombuffer(x, dtype).astype(np.float64))) for x in raw]
            ids = [sorted(x)[:least] for x in seen.values()]
            yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), pa.array(raw, pa.binary()), pa.array(norms), pa.array(ids, pa.list_(pa.int64()))], ["d1", "d2", "vec", "norm", "ids"])
            seen.clear()

        for batch in batches:
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = seen.setdefault((vector.values.to_numpy(zero_copy_only=False) + 0.0).astype(dtype).tobytes(), [])
                ids.append(key)
                if len(ids) > 50 * least:
                    ids[:] = sorted(ids)[:least]
            if len(seen) > 100_000:
                yield from give()
        if seen:
            yield from give()

    return run


def _digests(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    import hashlib

    both = np.frombuffer(b"".join(hashlib.md5(x).digest() for x in raw), np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _with_digest(dtype: str):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw = [(v.values.to_numpy(zero_copy_only=False) + 0.0).astype(dtype).tobytes() for v in batch.column(1)]
        d1, d2 = _digests(raw)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d1), pa.array(d2)], ["query_id", "d1", "d2"])

    return run


def _band(norm: Column, middle: float) -> Column:
    """Lengths within a factor of sqrt 2; lengths near ``middle`` are in the midst of band 0."""
    return F.floor(2 * F.log2(norm / middle) + 0.5).cast("int")


def _points(dtype: str, curves: int, bands: list[int]):
    """(rep, vec, norm, asked, band) -> one row for each curve of its band, and for a query one for each curve of every
    band.  Within a band lengths differ little, so that the inner product's order is nearly the direction's order."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = _numbers(batch, "vec", dtype) / batch.column(2).to_numpy()[:, None]
        asked = np.flatnonzero(batch.column(3).to_numpy(zero_copy_only=False))
        band = np.searchsorted(bands, batch.column(4).to_numpy())
        rep = batch.column(0).to_numpy()
        for c in range(curves):
            key = curve_keys(x, c)
            for i in range(-1, len(bands)):
                own = np.arange(len(rep)) if i < 0 else asked
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(((band if i < 0 else np.full(len(own), i)) * curves + c).astype(np.int32)),
                        pa.array(key[own]),
                        pa.array(rep[own]),
                        pa.array(np.full(len(own), i >= 0)),
                    ],
                    ["curve", "key", "rep", "query"],
                )

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> how many stored vectors of the same curve stand before each in this partition."""
    part, before = TaskContext.get().partitionId(), {}
    for batch in batches:
        curve, query = batch.column(0).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
        place = np.zeros(len(curve), np.int64)
        for c in np.unique(curve).tolist():
            own = np.flatnonzero(curve == c)
            count = np.cumsum(~query[own])
            place[own] = before.get(c, 0) + count - ~query[own]
            before[c] = before.get(c, 0) + int(count[-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(np.full(len(curve), part, np.int32)), pa.array(place)], ["curve", "rep", "query", "part", "place"])


def _rank(dtype: str, window: int, best: int):
    """A cell of a curve and the queries next to it: each query's best vectors there."""

    def run(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        is_query = batch.column(batch.schema.get_field_index("query")).to_numpy(zero_copy_only=False)
        vec, rep, place = _numbers(batch, "vec", dtype), table["rep"].to_numpy(), table["place"].to_numpy()
        length = np.linalg.norm(vec, axis=1)
        q, s = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        out: list[tuple] = []
        for lo in range(0, len(q) if len(s) else 0, 256):
            own = q[lo : lo + 256]
            score = vec[own] @ vec[s].T
            score[np.abs(place[own][:, None] - place[s]) > window] = -np.inf
            near = min(best, len(s))
            least = np.partition(score, len(s) - near, axis=1)[:, len(s) - near]
            # products of a matrix may differ from exact ones in the last digits: all that may be among the best are kept
            slack = 1e-12 * vec.shape[1] * length[own] * length[s].max()
            for row, (i, low) in enumerate(zip(own.tolist(), (least - slack).tolist(), strict=True)):
                cols = np.flatnonzero((score[row] >= low) & (score[row] > -np.inf))
                exact = (vec[s[cols]] * vec[i]).sum(axis=1)
                order = np.lexsort((rep[s[cols]], -exact))[:best]
                out += zip([int(rep[i])] * len(order), rep[s[cols]][order].tolist(), exact[order].tolist(), strict=True)
        return pa.table({"q": pa.array([x[0] for x in out], pa.int64()), "rep": pa.array([x[1] for x in out], pa.int64()), "score": pa.array([x[2] for x in out], pa.float64())})

    return run


def _scan(asked: list[int], vectors: np.ndarray, dtype: str, best: int):
    """(rep, vec) -> the best others of a task for each of the asked vectors, by brute force."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, reps = np.zeros((len(asked), 0)), np.zeros((len(asked), 0), np.int64)
        for batch in batches:
            if batch.num_rows:
                rep = batch.column(0).to_numpy()
                new = vectors @ _numbers(batch, "vec", dtype).T
                new[np.array(asked)[:, None] == rep] = -np.inf
                score, reps = np.hstack([score, new]), np.hstack([reps, np.broadcast_to(rep, new.shape)])
                top = np.argsort(-score, axis=1, kind="stable")[:, :best]
                score, reps = np.take_along_axis(score, top, 1), np.take_along_axis(reps, top, 1)
        real = score > -np.inf
        q = np.broadcast_to(np.array(asked)[:, None], score.shape)
        yield pa.RecordBatch.from_arrays([pa.array(q[real]), pa.array(reps[real]), pa.array(score[real])], ["q", "rep", "score"])

    return run


def _fitted(point: DataFrame, query: DataFrame, numbered: DataFrame, scratch: Scratch, dtype: str, k: int, window: int, recall: float) -> int:
    """The least window, ``window`` at least, that holds the share ``recall`` of sampled queries' true neighbours."""
    drawn = query.select("rep").distinct().orderBy(F.xxhash64("rep", F.lit(9))).limit(SAMPLE)
    drawn = point.select("rep", "vec").join(drawn, "rep", "left_semi").toArrow().combine_chunks()
    if not drawn.num_rows:
        return window
    asked, vectors = drawn["rep"].to_pylist(), _numbers(drawn.to_batches()[0], "vec", dtype)
    found = point.select("rep", "vec").mapInArrow(_scan(asked, vectors, dtype, k), "q long, rep long, score double")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))
    true = scratch.table(found.withColumn("nth", nth).where(F.col("nth") <= k).select("q", "rep"), "true")
    own = numbered.where("query").join(true.select(F.col("q").alias("rep")).distinct(), "rep").select(F.col("rep").alias("q"), "curve", F.col("place").alias("at"))
    away = numbered.where("NOT query").join(true, "rep").join(own, ["q", "curve"]).groupBy("q", "rep").agg(F.min(F.abs(F.col("place") - F.col("at"))).alias("away"))
    least = away.agg(F.percentile("away", F.lit(recall))).first()[0]
    return max(window, int(np.ceil(least or 0)))


def nearest(df: DataFrame, every: int = 20, k: int = 20, curves: int = CURVES, window: int = WINDOW, recall: float = RECALL) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, the ``k``
    others of largest inner product found, ties to the smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, neither as queries; of
    vectors of several dimensions those of the commonest one do (of equally common ones, the largest).  Rows without an
    id take no part; rows that repeat an id are found as often as they stand.  Fewer than k others give as many rows; an
    empty table gives an empty result.  All valid rows are indexed.  ``window`` is widened as far as sampled queries need
    for ``recall``; 0 leaves it as it is.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "curves")
    dtype = "<f4" if "float" in df.schema["embedding"].dataType.simpleString() else "<f8"
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    valid = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", bad)
    )
    common = valid.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    valid = valid.where(F.size("embedding") == (common["size"] if common else 0))
    part = valid.mapInArrow(_distinct(dtype, k + 1), "d1 long, d2 long, vec binary, norm double, ids array<long>")
    few = lambda c: F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, k + 1)
    halves = part.groupBy("d1", "d2", F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("salt")).agg(F.first("vec").alias("vec"), F.first("norm").alias("norm"), few("ids").alias("ids"))
    whole = halves.groupBy("d1", "d2").agg(F.first("vec").alias("vec"), F.first("norm").alias("norm"), few("ids").alias("ids"))
    point = scratch.table(whole.withColumn("rep", F.element_at("ids", 1)), "points")
    asked = map_batches(valid.where(F.col("vec_id") % every == 0), _with_digest(dtype), "query_id long, d1 long, d2 long")
    query = scratch.table(asked.join(point.select("d1", "d2", "rep"), ["d1", "d2"]).select("query_id", "rep"), "queries")
    middle = point.agg(F.percentile_approx("norm", 0.5)).first()[0] or 1.0
    banded = point.select("rep", "vec", "norm", _band(F.col("norm"), middle).alias("band"))
    bands = sorted(r["band"] for r in banded.select("band").distinct().collect())
    flagged = banded.join(query.select("rep", F.lit(True).alias("asked")).distinct(), "rep", "left").select("rep", "vec", "norm", F.coalesce("asked", F.lit(False)).alias("asked"), "band")
    placed = map_batches(flagged, _points(dtype, curves, bands), "curve int, key long, rep long, query boolean")
    ordered = placed.repartitionByRange(partitions(spark), "curve", "key", "rep").sortWithinPartitions("curve", "key", "rep", "query")
    ordered = scratch.table(ordered.mapInArrow(_number, "curve int, rep long, query boolean, part int, place long"), "ordered")
    size = ordered.where(~F.col("query")).groupBy("curve", "part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.select("curve", "part").distinct().join(size, ["curve", "part"], "left").select("curve", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    numbered = ordered.join(parts, ["curve", "part"]).select("curve", "rep", "query", (F.col("place") + F.col("ahead")).alias("place"))
    if recall and point.count() > window:
        window = _fitted(point, query, numbered, scratch, dtype, k, window, recall)
    step = min(window, CELL)
    cell, reach = F.floor(F.col("place") / step), -(-window // step)
    cells = F.when(F.col("query"), F.sequence(cell - reach, cell + reach)).otherwise(F.array(cell))
    near = numbered.join(point.select("rep", "vec"), "rep").select("curve", F.explode(cells).alias("cell"), "rep", "query", "place", "vec")
    found = near.groupBy("curve", "cell").applyInArrow(_rank(dtype, window, k + 1), "q long, rep long, score double")
    # merge the curves, then list ids
    best = found.groupBy("q", "rep").agg(F.max("score").alias("score"))
    by_query = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    best = best.withColumn("nth", F.row_number().over(by_query)).where(F.col("nth") <= k + 1)
    listed = best.join(point.select("rep", "ids"), "rep").select(F.col("q").alias("rep"), "score", F.explode("ids").alias("vec_id"))
    listed = listed.withColumn("nth", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id"))).where(F.col("nth") <= k + 1)
    rows = query.join(listed, "rep").where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
