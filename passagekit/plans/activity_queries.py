"""Registered queries of tool calls, previews, models and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activity as A
from ..operators.catalog import video_statuses
from ..sources import tables as T
from .registry import query


@query("tool_calls", "SELECT doc_id AS message_id, 0 AS call, lang AS query, doc_id AS k FROM documents WHERE doc_id % 4 <> 3")
def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """Arguments in parts of seven characters; every fourth is cut off."""
    i = F.col("doc_id")
    whole = F.to_json(F.struct(F.col("lang").alias("query"), i.alias("k")))
    raw = F.when(i % 4 == 3, F.substring(whole, 1, 12)).otherwise(whole)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length("raw") - 1) / 7).cast("int")), lambda n: F.substring("raw", n * 7 + 1, F.lit(7)))
    f = T.table(spark, d, "documents").select(i.alias("message_id"), F.lit(0).alias("call"), raw.alias("raw"))
    return A.assemble_calls(f.select("message_id", "call", F.posexplode(parts).alias("pos", "part")), "query string, k long")


@query("replayed_blocks", "SELECT event_id, CASE WHEN event_type IN ('view', 'error') THEN 1 ELSE 0 END + CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS n FROM events WHERE event_type <> 'signup' UNION ALL SELECT event_id, 1 FROM events WHERE event_type = 'signup'")
def replayed_blocks(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    first = F.when(kind.isin("view", "error"), "search_web").when(kind == "click", "read_section").otherwise("find_passages")
    second = F.when(kind == "click", F.lit(None).cast("string")).otherwise("notes")
    blocks = F.array(F.struct(first.alias("name")), F.struct(second.alias("name")))
    return A.replayable(T.table(spark, d, "events").select("event_id", blocks.alias("tool_blocks"))).select("event_id", F.size("tool_blocks").alias("n"))


@query(
    "part_expansion",
    """SELECT asked, asked AS part_id FROM (SELECT 'b' || n_nationkey || '_p2' AS asked FROM nation WHERE n_nationkey % 2 = 0)
       UNION ALL SELECT 'b' || n_nationkey, 'b' || n_nationkey || '_p' || p FROM nation, (SELECT unnest([1, 2, 3]) AS p) WHERE n_nationkey % 2 = 1""",
)
def part_expansion(spark: SparkSession, d: str) -> DataFrame:
    base = F.concat(F.lit("b"), F.col("n_nationkey").cast("string"))
    n = T.table(spark, d, "nation")
    listing = n.select(base.alias("base"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("part"))
    return A.expand_parts(n.select(F.when(F.col("n_nationkey") % 2 == 0, F.concat(base, F.lit("_p2"))).otherwise(base).alias("asked")), listing)


@query(
    "preview_state",
    """SELECT seg, n, n_new, n_auth, CASE WHEN n = 1 AND n_new = 0 THEN 'single' WHEN n_auth > 0 THEN 'needs_auth' WHEN n_new = 0 THEN 'none_new' ELSE 'some' END AS state FROM (
         SELECT c_mktsegment AS seg, count(*) AS n, count(*) FILTER (WHERE s.video_id IS NULL AND j.video_id IS NULL) AS n_new, 0::BIGINT AS n_auth
         FROM (SELECT c_mktsegment, 'v' || c_custkey AS video_id FROM customer) c LEFT JOIN (SELECT DISTINCT 'v' || source_id AS video_id FROM src) s USING (video_id)
         LEFT JOIN (SELECT DISTINCT video_id FROM job WHERE status IN ('queued', 'downloading', 'transcribing', 'processing')) j USING (video_id) GROUP BY c_mktsegment)""",
)
def preview_state(spark: SparkSession, d: str) -> DataFrame:
    ids = T.table(spark, d, "customer").select(F.col("c_mktsegment").alias("seg"), F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("video_id"))
    done = T.sources(spark, d).select(F.concat(F.lit("v"), F.col("source_id").cast("string")).alias("video_id"))
    return A.preview(video_statuses(ids, T.jobs(spark, d), done), "seg")


@query(
    "model_states",
    """SELECT 'm' || n_nationkey AS model, n_regionkey = 1 AS required, CASE WHEN n_regionkey = 2 THEN 'installed' WHEN n_nationkey IN (SELECT entity FROM job WHERE status IN ('queued', 'downloading', 'transcribing', 'processing')) THEN 'downloading'
              WHEN n_regionkey = 1 THEN 'missing' ELSE 'optional' END AS state FROM nation""",
)
def model_states(spark: SparkSession, d: str) -> DataFrame:
    named = lambda c: F.concat(F.lit("m"), F.col(c).cast("string")).alias("model")
    n = T.table(spark, d, "nation")
    models = n.select(named("n_nationkey"), (F.col("n_regionkey") == 1).alias("required"))
    return A.model_states(models, n.where("n_regionkey = 2").select(named("n_nationkey")), T.jobs(spark, d).select(named("entity"), "status"))


@query("health_rollup", "SELECT c_nationkey, CASE WHEN bool_or(c_acctbal < 0 AND c_mktsegment = 'BUILDING') THEN 'error' WHEN bool_or(c_acctbal < 0) THEN 'degraded' ELSE 'ok' END AS state FROM customer GROUP BY c_nationkey")
def health_rollup(spark: SparkSession, d: str) -> DataFrame:
    c = T.table(spark, d, "customer").select("c_nationkey", (F.col("c_acctbal") >= 0).alias("ok"), (F.col("c_mktsegment") == "BUILDING").alias("blocking"))
    return A.health(c, "c_nationkey")


@query("graded_runs", "SELECT r AS run_id, r IN (SELECT run_id FROM grade) AS graded FROM (SELECT unnest([1, 2, 3]) AS r)")
def graded_runs(spark: SparkSession, d: str) -> DataFrame:
    return A.runs_by_grading(spark.createDataFrame([(1,), (2,), (3,)], "run_id int"), T.grades(spark, d))


@query(
    "report_cases",
    """SELECT a.case_id, coalesce(c.category, 'unknown') AS category, a.groundedness AS score, a.groundedness - b.groundedness AS change FROM grade a
       LEFT JOIN (SELECT item_id AS case_id, 'cat' || (item_id % 9) AS category FROM benchmark WHERE item_id % 10 <> 0) c USING (case_id) LEFT JOIN (SELECT * FROM grade WHERE run_id = 1) b USING (case_id) WHERE a.run_id = 2""",
)
def report_cases(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth case is not among the cases any more."""
    i = F.col("item_id")
    cases = T.table(spark, d, "benchmark").where(i % 10 != 0).select(i.alias("case_id"), F.concat(F.lit("cat"), (i % 9).cast("string")).alias("category"))
    return A.report_cases(cases, T.grades(spark, d), 2, 1, "groundedness")


@query("cited_calls", "SELECT query_id, source_id, section_seq, index, index = query_id % 4 + 1 AS cited FROM numbered")
def cited_calls(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.evidence import allocate, chunk_sections
    from .retrieval_queries import questions, retrieved, sections

    calls = allocate(chunk_sections(retrieved(spark, d), sections(spark, d))).drop("first_rank")
    return A.cited_calls(calls, questions(spark, d).select("query_id", (F.col("query_id") % 4 + 1).cast("int").alias("index")))


@query("expanded_bases", "SELECT CASE WHEN doc_id % 3 = 0 THEN 'BV' || (doc_id // 12) ELSE 'x' || doc_id END AS base, count(*) AS n FROM documents GROUP BY 1")
def expanded_bases(spark: SparkSession, d: str) -> DataFrame:
    """Ids with parts by the id they are parts of."""
    from ..functions.text import split_video_id

    i = F.col("doc_id")
    video = F.when(i % 3 == 0, F.concat(F.lit("BV"), F.floor(i / 12).cast("string"), F.lit("_p"), (i % 12).cast("string"))).otherwise(F.concat(F.lit("x"), i.cast("string")))
    return T.table(spark, d, "documents").select(split_video_id(video)[0].alias("base")).groupBy("base").agg(F.count("*").alias("n"))
