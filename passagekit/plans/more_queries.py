"""Registered queries of small functions and of stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import store
from ..sources import tables as T
from ..sources.scratch import folder
from .registry import query


@query("strip_marks", "SELECT doc_id, md5(translate(text, '，。！？、；：．…,.!?;: 　', '')) AS bare FROM documents")
def strip_marks(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "documents").select("doc_id", F.md5(X.strip_marks(F.col("text"))).alias("bare"))


@query("speaker_labels", "SELECT event_id, CASE WHEN event_type <> 'error' THEN 'SPK_' || user_id END AS label, round(event_id / 1000.0, 3) AS s FROM events")
def speaker_labels(spark: SparkSession, d: str) -> DataFrame:
    number = F.when(F.col("event_type") != "error", F.col("user_id"))
    return T.table(spark, d, "events").select("event_id", X.speaker_label(number).alias("label"), F.round(X.seconds(F.col("event_id")), 3).alias("s"))


@query("safe_durations", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN floor(value)::BIGINT ELSE 0 END AS seconds FROM events")
def safe_durations(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_type").isin("view", "click"), F.col("value").cast("string")).when(F.col("event_type") == "error", "n/a")
    return T.table(spark, d, "events").select("event_id", X.safe_duration(raw).alias("seconds"))


@query(
    "error_classes",
    "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'needs_auth' WHEN 2 THEN 'not_found' WHEN 3 THEN 'timeout' WHEN 4 THEN 'needs_auth' ELSE 'internal_error' END AS class FROM events",
)
def error_classes(spark: SparkSession, d: str) -> DataFrame:
    says = ["HTTP 429: slow down", "Please sign in to see this", "The video was removed", "read timed out", "403, not found", "broken pipe"]
    message = F.element_at(F.array(*map(F.lit, says)), (F.col("event_id") % 6 + 1).cast("int"))
    return T.table(spark, d, "events").select("event_id", X.error_class(message).alias("class"))


@query("chunk_ids", "SELECT chunk_id, source_id || '_' || floor(timestamp_start)::BIGINT || '_' || floor(timestamp_end)::BIGINT AS shown, chunk_index::INT AS n, CASE WHEN source_id % 2 = 0 THEN chunk_index::INT END AS half FROM chunk")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    c = T.chunks(spark, d)
    half = F.when(F.col("source_id") % 2 == 0, F.col("chunk_id")).otherwise("none_x")
    return c.select(
        "chunk_id", X.shown_id(F.col("source_id"), F.col("timestamp_start"), F.col("timestamp_end")).alias("shown"), X.sequence_index(F.col("chunk_id")).alias("n"), X.sequence_index(half).alias("half")
    )


@query("url_resources", "SELECT page_id, CASE WHEN regexp_matches(url, '/(course|cheese)/') THEN 'course' WHEN regexp_matches(url, '[?&](list|playlist)=|/playlist') THEN 'playlist' ELSE 'video' END AS kind, nullif(regexp_extract(url, '[?&]p(?:age)?=([0-9]+)', 1), '')::INT AS part FROM pages")
def url_resources(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "pages").select("page_id", X.resource_type(F.col("url")).alias("kind"), X.part_number(F.col("url")).alias("part"))


@query("cookie_rows", "SELECT c_custkey, 'name' AS k, c_name AS v FROM customer UNION ALL SELECT c_custkey, 'seg', c_mktsegment || '=x' FROM customer")
def cookie_rows(spark: SparkSession, d: str) -> DataFrame:
    header = F.concat(F.lit("name="), F.col("c_name"), F.lit("; =lost; seg="), F.col("c_mktsegment"), F.lit("=x; alone"))
    return T.table(spark, d, "customer").select("c_custkey", F.explode(X.cookies(header)).alias("k", "v"))


@query("public_keys", "SELECT c_custkey, 'name' AS k, c_name AS v FROM customer")
def public_keys(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("name"), F.col("c_name"), F.lit("_raw"), F.col("c_mktsegment"))
    return T.table(spark, d, "customer").select("c_custkey", F.explode(X.without_private(m)).alias("k", "v"))


@query("transcript_languages", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'zh' WHEN 1 THEN lang ELSE 'en' END AS language, greatest(1, least(16, 64 // (doc_id % 80 + 1)))::INT AS connections FROM documents")
def transcript_languages(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id") % 3
    asked, heard = F.when(i == 0, "zh").when(i == 1, "auto").otherwise(" "), F.when(i == 1, F.col("lang"))
    return T.table(spark, d, "documents").select("doc_id", X.transcript_language(asked, heard).alias("language"), X.connections(F.col("doc_id") % 80 + 1).alias("connections"))


@query("over_budget", "SELECT source_id, sum(tokens) + 4096 + 2048 > 8000 AS over FROM seg GROUP BY source_id")
def over_budget(spark: SparkSession, d: str) -> DataFrame:
    return T.segments(spark, d).groupBy("source_id").agg(X.over_budget(F.sum("tokens"), 4096, 8000).alias("over"))


@query("bm25_raw_text", "SELECT query_id, chunk_id, CASE WHEN chunk_id LIKE '%1' THEN md5(c.text) ELSE md5('raw ' || c.text) END AS text_md5 FROM textarm t JOIN chunk c USING (chunk_id) WHERE rank <= 10")
def bm25_raw_text(spark: SparkSession, d: str) -> DataFrame:
    """Hits with their raw text, or the indexed one where the raw text is missing or empty."""
    from .retrieval_queries import text_arm

    c = T.chunks(spark, d).select("chunk_id", "text")
    raw = c.select("chunk_id", F.when(F.col("chunk_id").endswith("1"), "").otherwise(F.concat(F.lit("raw "), "text")).alias("raw"))
    hits = text_arm(spark, d, 10).join(c, "chunk_id").join(raw, "chunk_id", "left")
    return hits.select("query_id", "chunk_id", F.md5(F.coalesce(F.nullif("raw", F.lit("")), "text")).alias("text_md5"))


@query("ingest_admission", "SELECT video_id, CASE WHEN video_id IN (SELECT video_id FROM src UNION SELECT video_id FROM job WHERE status IN ('queued', 'downloading', 'transcribing', 'processing', 'needs_auth')) THEN 'skipped' ELSE 'queued' END AS decision FROM (SELECT DISTINCT 'v' || c_custkey AS video_id FROM customer)")
def ingest_admission(spark: SparkSession, d: str) -> DataFrame:
    """New videos are queued, all others skipped."""
    from ..operators.catalog import video_statuses

    ids = T.table(spark, d, "customer").select(F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("video_id")).distinct()
    status = video_statuses(ids, T.jobs(spark, d), T.sources(spark, d))
    return status.select("video_id", F.when(F.col("status") == "new", "queued").otherwise("skipped").alias("decision"))


@query("replaced_partitions", "SELECT list_id, source_id, CASE WHEN list_id = 'src1' THEN 'new' ELSE 'old' END AS state FROM src WHERE list_id <> 'src1' OR source_id > 50")
def replaced_partitions(spark: SparkSession, d: str) -> DataFrame:
    """A list written again replaces its rows and no others."""
    path = folder(spark, "partitions") + "/table"
    s = T.sources(spark, d).select("source_id", "list_id")
    store.replace_partitions(s.withColumn("state", F.lit("old")), path, "list_id")
    store.replace_partitions(s.where("list_id = 'src1' AND source_id > 50").withColumn("state", F.lit("new")), path, "list_id")
    return spark.read.parquet(path).select("list_id", "source_id", "state")


@query("json_documents", "SELECT item_id AS id, 'cat' || (item_id % 9) AS category FROM benchmark WHERE item_id % 4 <> 3")
def json_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth document is cut off and left out."""
    path = folder(spark, "documents") + "/json"
    doc = F.to_json(F.struct(F.col("item_id").alias("id"), F.concat(F.lit("cat"), (F.col("item_id") % 9).cast("string")).alias("category")))
    T.table(spark, d, "benchmark").select(F.when(F.col("item_id") % 4 == 3, F.substring(doc, 1, 9)).otherwise(doc).alias("value")).write.text(path)
    return store.read_documents(spark, path, "id long, category string", "id")
