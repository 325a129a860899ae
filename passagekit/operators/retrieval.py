"""Hybrid retrieval: postings, exact nearest neighbours, rank fusion, reranking and the final cut.

Every operator works on a batch of queries at once; a limit for each query is a row number over the query, which Spark
turns into a partial limit before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_tokens

RRF = 60
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
QUERY_BLOCK, VECTOR_BLOCK = 4096, 50_000

Scorer = Callable[[str, list[str]], list[float]]
Rerank = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


# --- postings --------------------------------------------------------------------------------------------------------


def postings(chunks: DataFrame, columns: dict[str, Column] | None = None) -> DataFrame:
    """(col, term, chunk_id, tf, len) of each indexed column's tokens."""
    columns = columns or {"content": word_tokens(F.col("text"))}
    named = F.array(*(F.struct(F.lit(c).alias("col"), tokens.alias("tokens")) for c, tokens in columns.items()))
    held = chunks.select("chunk_id", named.alias("named"))
    size = F.aggregate("named", F.lit(0).cast("long"), lambda n, x: n + F.greatest(F.size(x["tokens"]), F.lit(0)))
    each = held.select("chunk_id", size.alias("len"), F.explode("named").alias("x")).select("chunk_id", "len", "x.col", F.explode("x.tokens").alias("term"))
    return each.groupBy("col", "term", "chunk_id", "len").agg(F.count("*").alias("tf"))


def top_k(df: DataFrame, k: int | Column, order: list[Column], by: str = "query_id", rank: str = "rank") -> DataFrame:
    """The first k of each query, ranked from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(rank) <= k)


# --- vectors ----------------------------------------------------------------------------------------------------------


def _scores(k: int, names: list[str], types: list[pa.DataType]):
    """A block of vectors and a block of queries: each query's k nearest of the block, ties by rounded distance and id."""

    def matrix(table: pa.Table) -> np.ndarray:
        return table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if vectors.num_rows and queries.num_rows:
            x, q = matrix(vectors), matrix(queries)
            ids, asked = np.array(vectors["chunk_id"].to_pylist(), object), queries["query_id"].to_pylist()
            square, own = (x * x).sum(axis=1), (q * q).sum(axis=1)
            near = min(k, len(x))
            for lo in range(0, len(q), 64):
                rough = own[lo : lo + 64, None] + square - 2 * q[lo : lo + 64] @ x.T
                limit = np.partition(rough, near - 1, axis=1)[:, near - 1] + 2e-9 + 1e-12 * x.shape[1] * (own[lo : lo + 64] + square.max())
                for i, (row, most) in enumerate(zip(rough, limit, strict=True), lo):
                    some = np.flatnonzero(row <= most)
                    exact = ((x[some] - q[i]) ** 2).sum(axis=1)
                    order = sorted(range(len(some)), key=lambda j: (round(exact[j], 9), ids[some[j]]))[:k]
                    out += [(asked[i], ids[some[j]], float(exact[j])) for j in order]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def block_scores(vectors: DataFrame, queries: DataFrame, key: list[str], k: int) -> DataFrame:
    """(query_id, chunk_id, distance): of each block of vectors (chunk_id, vector, key) the k nearest of each query in it."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("chunk_id", vectors.schema["chunk_id"].dataType), StructField("distance", DoubleType())])
    run = _scores(k, schema.fieldNames(), [to_arrow_type(f.dataType) for f in schema])
    return vectors.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(run, schema)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, max_distance: float | None = None) -> DataFrame:
    """The k nearest vectors (chunk_id, vector) of each query (query_id, vector), then those within a distance.

    Exact: blocks of queries meet blocks of vectors as matrices, and a block gives k rows a query.  The floor comes after
    the cut: far neighbours make no room for others.  Null vectors, and vectors of another number of components than a
    query's, are none of its neighbours.
    """
    blocks, splits = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-vectors.count() // VECTOR_BLOCK))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = vectors.where("vector IS NOT NULL").select("chunk_id", "vector", F.size("vector").alias("size"), F.pmod(F.xxhash64("chunk_id"), F.lit(splits)).cast("int").alias("split"), numbers(blocks).alias("block"))
    q = queries.where("vector IS NOT NULL").select("query_id", "vector", F.size("vector").alias("size"), numbers(splits).alias("split"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
    found = block_scores(v, q, ["split", "block", "size"], k)
    near = top_k(found, k, [F.asc(F.round("distance", 9)), F.asc("chunk_id")])
    return near if max_distance is None else near.where(F.col("distance") <= max_distance)


# --- fusion ------------------------------------------------------------------------------------------------------------


def fuse(first: DataFrame, second: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion of two ranked lists; ties keep the order in which keys came, the first list before the second."""
    both = first.select("query_id", key, "rank", F.lit(0).alias("arm")).unionByName(second.select("query_id", key, "rank", F.lit(1).alias("arm")))
    out = both.groupBy("query_id", key).agg(F.sum(1 / (F.lit(RRF) + F.col("rank"))).alias("score"), F.min(F.struct("arm", "rank")).alias("came"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "came")
    return out.withColumn("rank", F.row_number().over(w)).select("query_id", key, "score", "rank")


def hybrid(vector_arm: DataFrame, text_arm: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Fused where both arms of a query found something; else the other arm as it is, with its own scores.

    ``vector_arm`` has distance, ``text_arm`` has score; both have query_id, rank and the key.
    """
    has = lambda df, name: df.select("query_id").distinct().withColumn(name, F.lit(True))
    arms = has(vector_arm, "v").join(has(text_arm, "t"), "query_id", "full")
    both = arms.where("v AND t").select("query_id")
    none = F.lit(None).cast("double")
    fused = fuse(vector_arm, text_arm, key).join(both, "query_id", "left_semi").join(vector_arm.select("query_id", key, "distance"), ["query_id", key], "left")
    fused = fused.select("query_id", key, "rank", "score", F.coalesce("distance", F.lit(0.0)).alias("distance"))
    lone_v = vector_arm.join(both, "query_id", "left_anti").select("query_id", key, "rank", none.alias("score"), "distance")
    lone_t = text_arm.join(both, "query_id", "left_anti").select("query_id", key, "rank", "score", F.lit(0.0).alias("distance"))
    return fused.unionByName(lone_v).unionByName(lone_t)


def pool_size(sources_total: Column | int, k: int) -> Column:
    """How many candidates each arm gives: three for each source of the full pool, within 10 to 60."""
    total = F.lit(sources_total) if isinstance(sources_total, int) else sources_total
    return F.least(F.greatest(total * 3, F.lit(k), F.lit(10)), F.lit(60))


def lexical_rerank(candidates: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates by the share of the query's distinct terms that they hold; ties keep their rank.  A scorer without a model."""
    q = queries.select("query_id", F.array_distinct(word_tokens(F.col("text"))).alias("asked"))
    # only candidates' texts are cut into words
    c = chunks.join(candidates.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", F.array_distinct(word_tokens(F.col("text"))).alias("held"))
    share = F.size(F.array_intersect("asked", "held")) / F.greatest(F.size("asked"), F.lit(1))
    scored = candidates.join(q, "query_id").join(c, "chunk_id").withColumn("rerank_score", share).drop("asked", "held")
    return by_score(scored)


def by_score(scored: DataFrame) -> DataFrame:
    """Candidates (query_id, rank, rerank_score) in the order of their scores, ties as they were ranked.

    A query of whose candidates any has no score was not reranked: it keeps its order, and ``reranked`` says so.
    """
    whole = F.min(F.col("rerank_score").isNotNull()).over(Window.partitionBy("query_id"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.when(F.col("reranked"), F.col("rerank_score"))), "rank")
    return scored.withColumn("reranked", whole).withColumn("rank", F.row_number().over(w))


def model_rerank(scorer: Scorer) -> Rerank:
    """Reranking by a function of (question, texts) to as many numbers, such as a cross-encoder.

    A task gives it one question and its candidates at a time.  Where it raises, or gives no finite number for each text, the
    question's candidates have no score and keep their order.
    """

    def scores(question: str | None, texts: list[str]) -> list[float | None]:
        try:
            out = [float(x) for x in scorer(question or "", texts)]
        except Exception:  # noqa: BLE001 - a model may fail in any way, and only this question must not suffer
            return [None] * len(texts)
        return out if len(out) == len(texts) and all(map(math.isfinite, out)) else [None] * len(texts)

    def run(table: pa.Table) -> pa.Table:
        got = scores(table["question"][0].as_py(), [t or "" for t in table["text"].to_pylist()])
        return table.drop_columns(["question", "text"]).append_column("rerank_score", pa.array(got, pa.float64()))

    def rerank(candidates: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
        texts = chunks.join(candidates.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", "text")
        pairs = candidates.join(queries.select("query_id", F.col("text").alias("question")), "query_id").join(texts, "chunk_id")
        return by_score(pairs.groupBy("query_id").applyInArrow(run, pairs.drop("question", "text").withColumn("rerank_score", F.lit(None).cast("double")).schema))

    return rerank


def coverage(hits: DataFrame) -> DataFrame:
    """Each query's sources: number of chunks, and the first chunk with its score (negated), else its distance."""
    first = F.min_by(F.struct("chunk_id", F.coalesce(-F.col("score"), F.col("distance")).alias("best")), "rank")
    out = hits.groupBy("query_id", "source_id").agg(F.count("*").alias("n_chunks"), first.alias("f"))
    return out.select("query_id", "source_id", "n_chunks", F.col("f.chunk_id").alias("first_chunk_id"), F.col("f.best").alias("best_score"))


def retrieve(queries: DataFrame, vectors: DataFrame, chunks: DataFrame, scope: DataFrame, text_arm, keep, k: int = 8, rerank: Rerank | None = lexical_rerank) -> DataFrame:
    """The first k chunks of each question (query_id, text, vector) among a scope of sources (source_id).

    Each arm gives as many candidates as the scope's size asks for: ``text_arm`` of (size, pool) ranks chunks by words; the
    arms are fused where both found something; what they found is reranked, unless ``rerank`` is None.  Questions that the
    reranker fails for, and all without one, keep the order of the fusion, and ``reranked`` is false.  ``keep`` writes a
    small frame under a name and reads it again, so that it is made once.
    """
    pool = chunks.join(scope, "source_id", "left_semi").select("chunk_id")
    size = scope.agg(pool_size(F.count("*"), k).alias("size")).first()["size"]
    words = keep(text_arm(size, pool), "text-arm")
    near = keep(nearest(queries, vectors.join(pool, "chunk_id", "left_semi"), size), "vector-arm")
    found = keep(hybrid(near, words).where(F.col("rank") <= size), "candidates")
    if rerank is None:
        return found.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("reranked", F.lit(False)).where(F.col("rank") <= k)
    return rerank(found, queries, chunks).where(F.col("rank") <= k)
