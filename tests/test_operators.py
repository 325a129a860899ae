"""Retrieval, evidence, catalog and evaluation by example."""

from pyspark.sql import functions as F

from passagekit.operators import catalog as C
from passagekit.operators import evaluation as V
from passagekit.operators import evidence as E
from passagekit.operators import retrieval as R


def test_no_cap_on_chunks_of_one_source(spark):
    hits = spark.createDataFrame([(0, i, 0 if i < 6 else 1, i + 1, None, float(i)) for i in range(7)], "query_id long, chunk_id long, source_id long, rank int, score double, distance double")
    assert {(r.source_id, r.n_chunks, r.first_chunk_id) for r in R.coverage(hits).collect()} == {(0, 6, 0), (1, 1, 6)}


def test_turns(spark):
    rows = [(1, 0, "你好。", 157.0, "SPK_0"), (1, 1, "今天天气不错。", 158.0, "SPK_0"), (1, 2, "是啊。", 160.0, "SPK_1"), (2, 0, "text", 0.0, None), (2, 1, "more", 3725.0, None)]
    s = spark.createDataFrame(rows, "source_id long, seq int, text string, start_s double, speaker string")
    plain = {r.source_id: r.text for r in E.speaker_turns(s, ["source_id"]).collect()}
    assert plain == {1: "[SPK_0] 你好。 今天天气不错。\n[SPK_1] 是啊。", 2: "[SPK?] text more"}
    assert E.speaker_turns(s, ["source_id"], times=True).where("source_id = 1").first().text.startswith("[SPK_0 @2:37] ")
    named = {(r.source_id, r.speaker): r.spk for r in E.speaker_namespace(s, ["source_id"]).collect()}
    assert named == {(1, "SPK_0"): 0, (1, "SPK_1"): 1, (2, None): 0}


def test_fragments(spark):
    rows = [(1, 5, 6, "later"), (1, 0, 1, "earlier"), (2, 0, 1, "first"), (2, 2, 3, "second")]
    f = spark.createDataFrame(rows, "k int, seg_start int, seg_end int, body string")
    assert {r.k: r.body for r in E.join_fragments(f, ["k"]).collect()} == {1: "earlier\n\n[…]\n\nlater", 2: "first\nsecond"}


def test_held_numbers_stay(spark):
    hits = spark.createDataFrame([(0, 1, 0, 1), (0, 2, 0, 2), (0, 3, 0, 3)], "query_id long, source_id long, section_seq int, rank int")
    held = spark.createDataFrame([(0, 2, 0, 4)], "query_id long, source_id long, section_seq int, index int")
    assert {(r.source_id, r["index"]) for r in E.allocate(hits, held).collect()} == {(2, 4), (1, 5), (3, 6)}


def test_repeats_within_a_turn(spark):
    rows = [(0, 0, 1, "s1", 10.4, 20.9, "a"), (0, 1, 1, "s1", 10.0, 20.1, "b"), (0, 1, 2, "s1", 21.0, 30.0, "c")]
    hits = spark.createDataFrame(rows, "turn_id int, call int, rank int, source_id string, timestamp_start double, timestamp_end double, chunk_id string")
    assert {(r.chunk_id, r.shown_id) for r in E.dedup_turn(hits).collect()} == {("a", "s1_10_20"), ("c", "s1_21_30")}


def test_ledger_without_citations_stays_whole(spark):
    registry = spark.createDataFrame([(0, "x", 1), (0, "y", 2), (0, "z", 3), (1, "x", 1)], "query_id int, section_id string, index int")
    cover = registry.select("query_id", F.lit(0).alias("call"), F.col("index").alias("ord"), "section_id")
    cited = spark.createDataFrame([(0, 1), (0, 3)], "query_id int, index int")
    assert sorted((r.query_id, r["index"]) for r in E.ledger(cover, cited, registry).collect()) == [(0, 1), (0, 3), (1, 1)]


def test_video_statuses(spark):
    ids = spark.createDataFrame([(f"BV{i}",) for i in range(1, 6)], "video_id string")
    jobs = spark.createDataFrame([("BV2", "queued"), ("BV3", "needs_auth"), ("BV3", "queued"), ("BV5", "failed"), ("BV5", "done")], "video_id string, status string")
    done = spark.createDataFrame([("BV1",)], "video_id string")
    out = {r.video_id: r.status for r in C.video_statuses(ids, jobs, done).collect()}
    assert out == {"BV1": "processed", "BV2": "in_progress", "BV3": "needs_auth", "BV4": "new", "BV5": "new"}


def test_facet_scope(spark):
    pool = spark.createDataFrame([("a", 8), ("b", 9), ("c", 8), ("d", None)], "source_id string, sequence_number int")
    hit = C.facet_scope(pool, sequence_number=8).collect()
    assert {r.source_id for r in hit} == {"a", "c"} and {(r.matched_count, r.no_match) for r in hit} == {(2, False)}
    miss = C.facet_scope(pool, sequence_number=5).collect()
    assert len(miss) == 4 and {(r.matched_count, r.no_match) for r in miss} == {(0, True)}


def test_scores(spark):
    grades = spark.createDataFrame([(1, "a", 4, 3, 5), (1, "a", 5, 4, 4), (1, "b", 2, None, 3)], "run_id int, category string, context_relevance int, groundedness int, answer_relevance int")
    out = {r.category: (r.context_relevance, r.groundedness) for r in V.aggregate(grades).collect()}
    assert out["a"] == (4.5, 3.5) and out["b"] == (2.0, 0.0) and out["overall"][1] == 3.5
    assert V.failures(grades).first().groundedness == 1


def test_json_merge(spark):
    row = spark.range(1).select(C.merge_json(F.lit('{"a":"1","b":"2"}'), F.lit('{"b":"3"}')).alias("x"), C.merge_json(F.lit(None).cast("string"), F.lit('{"b":"3"}')).alias("y")).first()
    assert row.x == '{"a":"1","b":"3"}' and row.y == '{"b":"3"}'
