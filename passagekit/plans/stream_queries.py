"""Registered queries of streams: each runs over files that are there, and equals its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables as T
from ..sources.scratch import folder
from ..streaming import citations as C
from ..streaming import jobs as J
from .registry import query
from .text_queries import _answers

KNOWN = [1, 2, 3, 4, 5]
STEP = 5


def _replayed(df: DataFrame, path: str, files: int = 3) -> DataFrame:
    """A table as a stream of its files."""
    spark = df.sparkSession
    df.repartition(files).write.parquet(f"{path}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    """Answers in parts of five characters."""
    n = F.ceil(F.length("text") / STEP).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("text", i * STEP + 1, F.lit(STEP)))
    a = _answers(spark, d).select(F.col("doc_id").alias("message_id"), n.alias("n"), F.posexplode(parts).alias("pos", "delta"))
    return a.select("message_id", F.col("pos").cast("long").alias("pos"), "delta", (F.col("pos") == F.col("n") - 1).alias("last"), F.array(*map(F.lit, KNOWN)).alias("known"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "citations")
    return C.drain(C.parse_stream(_replayed(_deltas(spark, d), path)), path)


_BODY = r"(?:[Ss][Oo][Uu][Rr][Cc][Ee]|来源)? ?\d+(?: *[,，、] *\d+)*(?: *@ *\d+:\d\d(?::\d\d)?(?: *[-–—] *\d+:\d\d(?::\d\d)?)?)?"
CITED = "|".join(f"\\{a}{_BODY}\\{b}" if ord(a) < 128 else f"{a}{_BODY}{b}" for a, b in (("[", "]"), ("(", ")"), ("（", "）"), ("【", "】"), ("［", "］")))
#: The answers once more, what they cite, and what stands between; parsed by DuckDB's regular expressions.
ANSWERS = f"""answer AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'As said [' || (doc_id % 9) || '] and (Source 2, 3).' WHEN 1 THEN 'See 【1，' || (doc_id % 9) || '】 or [4 @ 1:02-1:05] here' WHEN 2 THEN 'No [12] nor [2) or [x]' ELSE 'Ends in [' END AS t FROM documents),
    split AS (SELECT doc_id, regexp_extract_all(t, '{CITED}') AS h, string_split_regex(t, '{CITED}') AS g FROM answer),
    read AS (SELECT doc_id, h, g, [[n::INT FOR n IN regexp_extract_all(regexp_replace(x, ' *@.*', ''), '[0-9]+')] FOR x IN h] AS ns FROM split)"""


@query(
    "citation_stream",
    f"""WITH {ANSWERS} SELECT doc_id AS message_id, array_to_string(list_filter(flatten(ns), lambda n: n BETWEEN 1 AND 5), ',') AS citations,
         array_to_string([g[i] || CASE WHEN i > len(h) THEN '' WHEN len(ns[i]) > 1 THEN array_to_string(list_filter(ns[i], lambda n: NOT n BETWEEN 1 AND 5), '') WHEN ns[i][1] BETWEEN 1 AND 5 THEN '' ELSE h[i] END FOR i IN range(1, len(g) + 1)], '') AS text FROM read""",
)
def citation_stream(spark: SparkSession, d: str) -> DataFrame:
    return _told(_events(spark, d))


def _told(e: DataFrame) -> DataFrame:
    own = lambda kind, sep: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("ord", "kind", "content"))), lambda x: x["kind"] == kind), lambda x: x["content"]), sep)
    return e.groupBy("message_id").agg(own("citation", ",").alias("citations"), own("text", "").alias("text"))


@query(
    "citation_stream_late",
    f"""WITH {ANSWERS} SELECT doc_id AS message_id, array_to_string(list_filter(flatten(ns), lambda n: n BETWEEN 1 AND 5), ',') AS citations,
         array_to_string([g[i] || CASE WHEN i > len(h) THEN '' WHEN len(ns[i]) > 1 THEN array_to_string(list_filter(ns[i], lambda n: NOT n BETWEEN 1 AND 5), '') WHEN ns[i][1] BETWEEN 1 AND 5 THEN '' ELSE h[i] END FOR i IN range(1, len(g) + 1)], '') AS text FROM read""",
)
def citation_stream_late(spark: SparkSession, d: str) -> DataFrame:
    """Later deltas come in earlier files, and every delta comes twice."""
    path = folder(spark, "late")
    deltas = _deltas(spark, d)
    deltas.orderBy(F.desc("pos"), "message_id").write.parquet(f"{path}/in")
    deltas.repartition(2).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(deltas.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    return _told(C.drain(C.parse_stream(stream), path))


@query("content_blocks", f"""WITH {ANSWERS}, bit AS (SELECT doc_id, i, 0 AS j, 'text' AS kind, g[i] AS c FROM (SELECT *, unnest(range(1, len(g) + 1)) AS i FROM read) UNION ALL
    SELECT doc_id, i, j, CASE WHEN n BETWEEN 1 AND 5 THEN 'citation' ELSE 'text' END, CASE WHEN len(ns) = 1 THEN h ELSE n::VARCHAR END FROM (SELECT *, ns[j] AS n FROM (SELECT *, unnest(range(1, len(ns) + 1)) AS j FROM (SELECT doc_id, i, h[i] AS h, ns[i] AS ns FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM read))))),
    parted AS (SELECT doc_id, kind, CASE WHEN kind = 'text' AND lag(kind) OVER w = 'text' THEN 0 ELSE 1 END AS new FROM bit WHERE c <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i, j))
    SELECT kind, sum(new)::BIGINT AS n FROM parted GROUP BY kind""")  # fmt: skip
def content_blocks(spark: SparkSession, d: str) -> DataFrame:
    return C.content_blocks(_events(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


@query("sse_payloads", "SELECT message_id AS stream_id, ord, CASE ord WHEN 0 THEN role ELSE '{\"n\":' || turn || '}' END AS payload FROM msg, (SELECT unnest([0, 1]) AS ord)")
def sse_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Two payloads, comments and a line without an end, cut into pieces of nine characters that come in any order."""
    number = F.concat(F.lit('{"n":'), F.col("turn").cast("string"), F.lit("}"))
    whole = F.concat(F.lit(": hello\n"), C.sse_text(F.col("role")), F.lit("event: x\n"), C.sse_text(number), F.lit("data: cut"))
    m = T.messages(spark, d).select(F.col("message_id").alias("stream_id"), whole.alias("t"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / 9).cast("int")), lambda i: F.substring("t", i * 9 + 1, F.lit(9)))
    pieces = m.select("stream_id", F.posexplode(cut).alias("pos", "piece")).withColumn("pos", F.col("pos").cast("long"))
    path = folder(spark, "sse")
    return C.drain(C.sse_payloads(_replayed(pieces, path)), path)


@query("job_state_stream", "SELECT entity, arg_max(status, (updated_at, job_id)) AS status, max(updated_at) AS updated_at FROM job GROUP BY entity")
def job_state_stream(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "jobs")
    jobs = T.jobs(spark, d).select("entity", "job_id", "status", "updated_at")
    return C.drain(C.job_states(_replayed(jobs, path)), path, "complete")


@query("turn_dedup_stream", "SELECT DISTINCT entity AS turn_id, video_id || ':' || status AS chunk_id FROM job")
def turn_dedup_stream(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "dedup")
    shown = T.jobs(spark, d).select(F.col("entity").alias("turn_id"), F.concat_ws(":", "video_id", "status").alias("chunk_id"), F.timestamp_micros("updated_at").alias("at"))
    return C.drain(C.unseen(_replayed(shown, path), "400 days").select("turn_id", "chunk_id"), path)


#: Jobs of the events' users; every third job that transcribes processes, and some need a sign-in.
STATUS = "CASE WHEN status = 'transcribing' AND job_id % 3 = 0 THEN 'processing' WHEN status = 'failed' AND job_id % 5 = 0 THEN 'needs_auth' ELSE status END"
MOVES = ", ".join(f"('{a}', '{b}', {J.PROGRESS.get(b, (0, 0))[0]}, {int(a in J.RETRIED)})" for a, bs in J.NEXT.items() for b in bs)
AGAIN = ", ".join(f"('{a}', '{a}', {J.PROGRESS[a][1]}, 0)" for a in J.PROGRESS if J.NEXT[a])
TRANSITIONS = f"""WITH RECURSIVE move AS (SELECT * FROM (VALUES {MOVES}, {AGAIN}) v(a, b, p, r)),
    ev AS (SELECT entity, updated_at, job_id, {STATUS} AS status, row_number() OVER (PARTITION BY entity ORDER BY updated_at, job_id) AS i FROM job WHERE entity IS NOT NULL),
    told AS (SELECT entity, 0::BIGINT AS i, NULL::BIGINT AS updated_at, NULL::BIGINT AS job_id, NULL::VARCHAR AS status, NULL::BOOLEAN AS accepted, '' AS state, 0 AS progress, 0 AS retries FROM (SELECT DISTINCT entity FROM ev)
      UNION ALL SELECT told.entity, ev.i, ev.updated_at, ev.job_id, ev.status, b IS NOT NULL, coalesce(b, state), coalesce(p, progress), retries + coalesce(r, 0)
                FROM told JOIN ev ON ev.entity = told.entity AND ev.i = told.i + 1 LEFT JOIN move ON a = state AND b = ev.status)
    SELECT entity, updated_at, job_id, status, accepted, state, progress, retries FROM told WHERE i > 0"""


def _job_events(spark: SparkSession, d: str) -> DataFrame:
    return T.jobs(spark, d).select("entity", "updated_at", "job_id", F.expr(STATUS).alias("status"))


@query("job_transitions", TRANSITIONS)
def job_transitions(spark: SparkSession, d: str) -> DataFrame:
    """The events of all users' jobs: which are accepted, and where each leaves its job."""
    return J.transitions(_job_events(spark, d), "entity", ("updated_at", "job_id"))


@query("job_transitions_stream", TRANSITIONS)
def job_transitions_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same events as a stream of three files in the order of time."""
    path = folder(spark, "transitions")
    jobs = _job_events(spark, d)
    cuts = [None, *jobs.approxQuantile("updated_at", [0.33, 0.66], 0.1), None]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = jobs if lo is None else jobs.where(F.col("updated_at") > lo)
        part = part if hi is None else part.where(F.col("updated_at") <= hi)
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(jobs.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    return C.drain(J.stream_transitions(stream, "entity", ("updated_at", "job_id")), path)


MINUTE = 60_000


@query("stream_state_evicted", f"SELECT doc_id AS message_id FROM documents WHERE doc_id * {MINUTE} + {5 * MINUTE} >= (SELECT max(doc_id) FROM documents) * {MINUTE} - {10 * MINUTE}")
def stream_state_evicted(spark: SparkSession, d: str) -> DataFrame:
    """Messages a minute apart, a watermark of ten minutes, state kept for five more: whose state is left at the end."""
    path = folder(spark, "evicted")
    deltas = _deltas(spark, d).withColumn("at", F.timestamp_millis(F.col("message_id") * MINUTE))
    most = deltas.agg(F.max("message_id")).first()[0]
    for nth in range(4):  # files in the order of time
        own = F.least(F.floor(F.col("message_id") * 4 / (most + 1)), F.lit(3)) == nth
        deltas.where(own).repartition(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(deltas.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in").withWatermark("at", "10 minutes")
    C.drain(C.parse_stream(stream, 5 * MINUTE, "at"), path)
    return C.kept_messages(spark, f"{path}/checkpoint")
