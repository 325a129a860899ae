"""Searching texts that have no index: counts of shards against plain dictionaries and the stored index; chunks from documents."""

import pytest
from pyspark.sql import functions as F

from passagekit.operators import inverted as V
from passagekit.plans import QUERIES
from passagekit.plans import retrieval_queries as Q
from passagekit.sources import tables as T

from .test_inverted import CHUNK, corpus, plain

AWKWARD = ["国地 sounds as 国地敌方. Ünïcode ÀÉ straße", "İstanbul ΑΣ.Α ²³ Ⅷ x̂ ﬁ 123", "國", "…", "", None, "the ñandú Ÿ 苹果,the the"]


def found(frame):
    return sorted((r.query_id, r.chunk_id, round(r.score, 6), r["rank"]) for r in frame.collect())


@pytest.mark.parametrize("shard, batch, block", [(20_000, 200_000, 4096), (50, 40, 3)])
def test_texts_are_searched_without_an_index(spark, monkeypatch, shard, batch, block):
    monkeypatch.setattr(V, "SEED", 20)
    monkeypatch.setattr(V, "QUERY_BLOCK", block)
    have = corpus(1, list(range(40)))
    queries = [(i, t) for i, (_, _, t) in enumerate(corpus(9, list(range(6)))[::4]) if t] + [(900, "w1 w1 w2 w1 w3"), (901, "nothing here"), (902, "w1"), (903, None), (904, "w1")]
    # workers import the module anew, so limits that they see go with the function
    counted = V._counted
    monkeypatch.setattr(V, "_counted", lambda schema: counted(schema, shard, batch))
    terms = V.query_terms(spark.createDataFrame(queries, "query_id long, text string"))
    chunks = spark.createDataFrame(have, CHUNK)
    asked = [(q, t or "") for q, t in queries]
    assert found(V.search_texts(chunks, terms, 7)) == plain(have, asked, 7)
    pool = {x[0] for x in have if x[1] % 2}
    frame = spark.createDataFrame([(c,) for c in [*pool, *pool, "unknown"]], "chunk_id string")
    assert found(V.search_texts(chunks, terms, 5, pool=frame)) == plain(have, asked, 5, pool)
    assert found(V.search_texts(chunks.where("false"), terms, 5)) == []
    assert found(V.search_texts(chunks, terms.where("false"), 5)) == []


def test_awkward_texts_give_what_the_index_gives(spark, tmp_path):
    chunks = spark.createDataFrame([(f"{i}_0", i, t) for i, t in enumerate(AWKWARD * 3)], CHUNK)
    terms = V.query_terms(spark.createDataFrame([(i, t) for i, t in enumerate(AWKWARD)], "query_id long, text string"))
    V.write_segment(chunks, f"{tmp_path}/index", Q.COLUMNS)
    want = found(V.search(V.read_index(spark, f"{tmp_path}/index"), terms, 4))
    assert len(want) >= 12
    assert found(V.search_texts(chunks, terms, 4, Q.COLUMNS)) == want


def test_hybrid_search_builds_no_index_and_no_segments(spark, monkeypatch, tmp_path):
    for name in ("documents", "benchmark", "embeddings"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(V, "write_segment", None)
    monkeypatch.setattr(T, "split_segments", None)
    assert QUERIES["hybrid_search"](spark, str(tmp_path)).count() > 0


def test_chunks_come_straight_from_documents(spark, tmp_path):
    texts = [None, "", " \n\t", "One. Two!  Three?\n\nFour…  \r\n five.six. seven.  \n \neight\n.nine", "国地。敌 😀 a.\nb" * 9, "\n\n.\n!lead. x", "no end"] * 3
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    s = T.segments(spark, str(tmp_path)).withColumn("chunk_index", F.floor(F.col("seq") / 6).cast("int"))
    want = s.groupBy("source_id", "chunk_index").agg(
        F.min("seq").alias("seg_start"), F.max("seq").alias("seg_end"), F.min("start_s").alias("timestamp_start"), F.max("end_s").alias("timestamp_end"), T.ordered_text("text", "seq", " ").alias("text")
    ).withColumn("chunk_id", F.concat_ws("_", "source_id", "chunk_index"))
    got = T.joined_chunks(spark, str(tmp_path))
    assert got.dtypes == want.dtypes
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 18
