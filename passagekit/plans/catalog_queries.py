"""Registered queries over the catalog's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..sources import tables as T
from .registry import query

#: Domains in the order in which they are tried.
DOMAINS = [("example.com", "com"), ("example.org", "org"), ("m.ththth.example.net", "mobile")]


@query("scan_sources_by_list", "SELECT source_id, title, processed_at FROM src WHERE list_id = 'src1'")
def scan_sources_by_list(spark: SparkSession, d: str) -> DataFrame:
    return T.sources(spark, d).where("list_id = 'src1'").select("source_id", "title", "processed_at").orderBy("processed_at", "source_id")


@query("source_lookup", "SELECT source_id, title, video_id FROM src WHERE source_id = 7")
def source_lookup(spark: SparkSession, d: str) -> DataFrame:
    return C.lookup(T.sources(spark, d), "source_id", 7).select("source_id", "title", "video_id")


@query("sources_by_ids", "SELECT source_id, title FROM src WHERE source_id IN (SELECT item_id FROM benchmark)")
def sources_by_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = T.table(spark, d, "benchmark").select(F.col("item_id").alias("source_id"))
    return C.by_keys(T.sources(spark, d), "source_id", ids).select("source_id", "title")


@query("source_facets", "SELECT source_id, sequence_number, season_number FROM src WHERE source_id IN (SELECT item_id FROM benchmark)")
def source_facets(spark: SparkSession, d: str) -> DataFrame:
    ids = T.table(spark, d, "benchmark").select(F.col("item_id").alias("source_id"))
    return C.by_keys(T.sources(spark, d), "source_id", ids).select("source_id", "sequence_number", "season_number")


@query("jobs_pending", "SELECT job_id, video_id, status, updated_at FROM job WHERE status IN ('queued', 'downloading', 'transcribing', 'processing')")
def jobs_pending(spark: SparkSession, d: str) -> DataFrame:
    return C.pending_jobs(T.jobs(spark, d)).select("job_id", "video_id", "status", "updated_at")


@query("job_meta_json_filter", "SELECT job_id, entity FROM job WHERE json_extract_string(meta, '$.k') = '42' AND status IN ('queued', 'downloading', 'transcribing', 'processing')")
def job_meta_json_filter(spark: SparkSession, d: str) -> DataFrame:
    return C.jobs_with_meta(T.jobs(spark, d), "$.k", "42").select("job_id", "entity")


@query("job_meta_merge", """SELECT job_id, CAST(json_extract(meta, '$.k') AS INT) AS k, 'x' AS stage FROM job WHERE status = 'failed'""")
def job_meta_merge(spark: SparkSession, d: str) -> DataFrame:
    merged = C.merge_json(F.col("meta"), F.lit('{"stage":"x"}'))
    j = T.jobs(spark, d).where("status = 'failed'").select("job_id", merged.alias("m"))
    return j.select("job_id", F.get_json_object("m", "$.k").cast("int").alias("k"), F.get_json_object("m", "$.stage").alias("stage"))


@query("activity_sort", "SELECT job_id, status, row_number() OVER (ORDER BY status IN ('done', 'failed', 'needs_auth'), updated_at DESC, job_id) AS place FROM job")
def activity_sort(spark: SparkSession, d: str) -> DataFrame:
    """All jobs as an activity list shows them, with their places."""
    jobs = T.jobs(spark, d).select("job_id", "status", "updated_at")
    return C.numbered(jobs, C.activity(), "place").select("job_id", "status", "place")


@query("job_latest_state", "SELECT entity, arg_max(status, (updated_at, job_id)) AS status, max(updated_at) AS updated_at FROM job GROUP BY entity")
def job_latest_state(spark: SparkSession, d: str) -> DataFrame:
    return C.latest_state(T.jobs(spark, d), "entity", ["updated_at", "job_id"], "status", "updated_at")


@query("job_state_counts", "SELECT status, count(*) AS n FROM job GROUP BY status")
def job_state_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.jobs(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "facet_scope_fail_open",
    """
    WITH f AS (SELECT 'hit' AS asked, source_id, coalesce(sequence_number = 4 AND season_number = 1, false) AS hit FROM src
               UNION ALL SELECT 'miss', source_id, coalesce(sequence_number = 4 AND season_number = 2, false) FROM src
               UNION ALL SELECT 'all', source_id, true FROM src),
    n AS (SELECT asked, count(*) FILTER (WHERE hit) AS c FROM f GROUP BY asked)
    SELECT asked, source_id, CASE WHEN asked <> 'all' THEN c END AS matched_count, c = 0 AS no_match FROM f JOIN n USING (asked) WHERE hit OR c = 0""",
)
def facet_scope_fail_open(spark: SparkSession, d: str) -> DataFrame:
    pool = T.sources(spark, d).select("source_id", "sequence_number", "season_number")
    out = [
        C.facet_scope(pool, **f).select(F.lit(n).alias("asked"), "source_id", "matched_count", "no_match")
        for n, f in {"hit": {"sequence_number": 4, "season_number": 1}, "miss": {"sequence_number": 4, "season_number": 2}, "all": {}}.items()
    ]
    return out[0].union(out[1]).union(out[2])


@query(
    "truncation_status",
    """SELECT source_id, CASE WHEN container <= 0 AND expected <= 0 THEN 'unverified' WHEN (container > 0 AND decoded < container * 0.9) OR (expected > 0 AND decoded < expected * 0.9)
              THEN 'truncated' ELSE 'ok' END AS status
       FROM (SELECT source_id, coalesce(duration_seconds, 0) AS container, coalesce(duration_seconds, 0) AS expected, coalesce(heard, 0) AS decoded
             FROM src LEFT JOIN (SELECT source_id, max(end_s) AS heard FROM seg GROUP BY source_id) USING (source_id))""",
)
def truncation_status(spark: SparkSession, d: str) -> DataFrame:
    heard = T.segments(spark, d).groupBy("source_id").agg(F.max("end_s").alias("heard"))
    s = T.sources(spark, d).join(heard, "source_id", "left")
    return s.select("source_id", C.truncation_status(F.col("heard"), F.col("duration_seconds"), F.col("duration_seconds")).alias("status"))


@query(
    "video_status",
    """SELECT v.video_id, CASE WHEN auth THEN 'needs_auth' WHEN busy THEN 'in_progress' WHEN have THEN 'processed' ELSE 'new' END AS status
       FROM (SELECT DISTINCT 'v' || c_custkey AS video_id FROM customer) v
       LEFT JOIN (SELECT video_id, bool_or(status = 'needs_auth') AS auth, bool_or(status IN ('queued', 'downloading', 'transcribing', 'processing')) AS busy FROM job GROUP BY 1) j ON j.video_id = v.video_id
       LEFT JOIN (SELECT DISTINCT 'v' || source_id AS video_id, true AS have FROM src) s ON s.video_id = v.video_id""",
)
def video_status(spark: SparkSession, d: str) -> DataFrame:
    ids = T.table(spark, d, "customer").select(F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("video_id")).distinct()
    done = T.sources(spark, d).select(F.concat(F.lit("v"), F.col("source_id").cast("string")).alias("video_id"))
    return C.video_statuses(ids, T.jobs(spark, d), done)


@query(
    "list_display",
    """SELECT l.list_id, l.created_at, coalesce(max(processed_at), l.created_at) AS updated_at, count(source_id) AS video_count
       FROM lst l LEFT JOIN src s ON s.list_id = l.list_id GROUP BY l.list_id, l.created_at""",
)
def list_display(spark: SparkSession, d: str) -> DataFrame:
    return C.list_display(T.lists(spark, d), T.sources(spark, d))


@query("keyset_page", "SELECT message_id, role, created_at FROM msg WHERE conversation_id = 1 AND (created_at, message_id) < (SELECT (created_at, message_id) FROM msg WHERE message_id = 1003) ORDER BY created_at DESC, message_id DESC LIMIT 2")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return C.keyset_page(T.messages(spark, d), 1003, 2).select("message_id", "role", "created_at")


@query(
    "prior_user_prompt_asof",
    """SELECT message_id, prompt_id, u.content AS prompt
       FROM (SELECT message_id, role, max(CASE WHEN role = 'user' THEN message_id END) OVER (PARTITION BY conversation_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prompt_id FROM msg) m
       LEFT JOIN (SELECT message_id AS prompt_id, content FROM msg) u USING (prompt_id) WHERE role = 'assistant'""",
)
def prior_user_prompt_asof(spark: SparkSession, d: str) -> DataFrame:
    return C.prior_prompt(T.messages(spark, d))


@query(
    "messages_beyond_window",
    "SELECT message_id, conversation_id, role FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, message_id DESC) AS rn FROM msg WHERE status = 'done') WHERE rn > 2",
)
def messages_beyond_window(spark: SparkSession, d: str) -> DataFrame:
    return C.beyond_window(T.messages(spark, d), 2).select("message_id", "conversation_id", "role")


@query(
    "compaction_survivors",
    """SELECT message_id, conversation_id FROM msg WHERE message_id NOT IN (
         SELECT message_id FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, message_id DESC) AS rn, count(*) OVER (PARTITION BY conversation_id) AS n
                                 FROM msg WHERE status = 'done') WHERE n > 3 AND rn > 2)""",
)
def compaction_survivors(spark: SparkSession, d: str) -> DataFrame:
    return C.compact(T.messages(spark, d), 3, 2).select("message_id", "conversation_id")


@query("done_messages", "SELECT conversation_id, count(*) FILTER (WHERE status = 'done') AS n_done, count(*) AS n FROM msg GROUP BY conversation_id")
def done_messages(spark: SparkSession, d: str) -> DataFrame:
    return T.messages(spark, d).groupBy("conversation_id").agg(F.count_if(F.col("status") == "done").alias("n_done"), F.count("*").alias("n"))


#: A second reading of the sources: newer titles, facets where the list number says so.
STAGED = """SELECT video_id, list_id, 1000000 + min(source_id) AS source_id, 'New ' || max(source_id) AS title,
            max(CASE WHEN list_id = 'src1' THEN 99 END)::INT AS sequence_number FROM src WHERE list_id IN ('src1', 'src2') GROUP BY video_id, list_id
            UNION ALL SELECT 'w' || item_id, 'src3', 2000000 + item_id, 'Added ' || item_id, NULL FROM benchmark"""
FIRST = "SELECT video_id, list_id, min(source_id) AS source_id, arg_min(title, source_id) AS title, arg_min(sequence_number, source_id) AS sequence_number FROM src GROUP BY video_id, list_id"


def _base(spark: SparkSession, d: str) -> DataFrame:
    own = F.struct("title", "sequence_number")
    g = T.sources(spark, d).groupBy("video_id", "list_id").agg(F.min("source_id").alias("source_id"), F.min_by(own, "source_id").alias("x"))
    return g.select("video_id", "list_id", "source_id", "x.title", "x.sequence_number")


def _staged(spark: SparkSession, d: str) -> DataFrame:
    old = T.sources(spark, d).where("list_id IN ('src1', 'src2')").groupBy("video_id", "list_id")
    old = old.agg(
        (F.min("source_id") + 1_000_000).alias("source_id"),
        F.concat(F.lit("New "), F.max("source_id").cast("string")).alias("title"),
        F.max(F.when(F.col("list_id") == "src1", 99)).alias("sequence_number"),
    )
    i = F.col("item_id")
    new = T.table(spark, d, "benchmark").select(
        F.concat(F.lit("w"), i.cast("string")).alias("video_id"), F.lit("src3").alias("list_id"), (i + 2_000_000).alias("source_id"), F.concat(F.lit("Added "), i.cast("string")).alias("title"), F.lit(None).cast("int").alias("sequence_number")
    )
    return old.unionByName(new)


@query(
    "upsert_sources",
    f"""WITH b AS ({FIRST.replace("arg_min(sequence_number, source_id)", "min_by(struct_pack(x := sequence_number), source_id).x")}), n AS ({STAGED})
        SELECT coalesce(b.video_id, n.video_id) AS video_id, coalesce(b.list_id, n.list_id) AS list_id, coalesce(b.source_id, n.source_id) AS source_id,
               CASE WHEN n.video_id IS NOT NULL THEN n.title ELSE b.title END AS title, coalesce(n.sequence_number, b.sequence_number) AS sequence_number
        FROM b FULL JOIN n ON b.video_id = n.video_id AND b.list_id = n.list_id""",
)
def upsert_sources(spark: SparkSession, d: str) -> DataFrame:
    return C.upsert(_base(spark, d), _staged(spark, d), ["video_id", "list_id"], ["source_id"], ["sequence_number"])


@query("facet_update_coalesce", "SELECT source_id, CASE WHEN list_id = 'src1' THEN coalesce(CASE WHEN source_id % 2 = 0 THEN 50 END, sequence_number) ELSE sequence_number END AS sequence_number FROM src")
def facet_update_coalesce(spark: SparkSession, d: str) -> DataFrame:
    s = T.sources(spark, d).select("source_id", "list_id", "sequence_number")
    patch = s.where("list_id = 'src1'").select("source_id", "list_id", F.when(F.col("source_id") % 2 == 0, 50).alias("sequence_number"))
    return C.upsert(s, patch, ["source_id", "list_id"], [], ["sequence_number"]).select("source_id", "sequence_number")


@query("facet_update_replace", "SELECT source_id, CASE WHEN list_id = 'src1' THEN CASE WHEN source_id % 2 = 0 THEN 50 END ELSE sequence_number END AS sequence_number FROM src")
def facet_update_replace(spark: SparkSession, d: str) -> DataFrame:
    s = T.sources(spark, d).select("source_id", "list_id", "sequence_number")
    patch = s.where("list_id = 'src1'").select("source_id", F.when(F.col("source_id") % 2 == 0, 50).alias("sequence_number"))
    return C.update_present(s, patch, "source_id", "sequence_number").select("source_id", "sequence_number")


@query(
    "cascade_delete",
    """SELECT 'parents' AS part, source_id, NULL::INT AS seq FROM src WHERE list_id <> 'src2'
       UNION ALL SELECT 'segments', source_id, seq::INT FROM seg WHERE source_id NOT IN (SELECT source_id FROM src WHERE list_id = 'src2')""",
)
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    s = T.sources(spark, d).select("source_id", "list_id")
    left = C.delete_cascade(s, {"segments": T.segments(spark, d).select("source_id", "seq")}, "source_id", s.where("list_id = 'src2'"))
    own = left["parents"].select(F.lit("parents").alias("part"), "source_id", F.lit(None).cast("int").alias("seq"))
    return own.union(left["segments"].select(F.lit("segments"), "source_id", "seq"))


@query("orphans_to_purge", "SELECT DISTINCT 'v' || entity AS video_id FROM job WHERE status <> 'done' AND 'v' || entity NOT IN (SELECT 'v' || source_id FROM src)")
def orphans_to_purge(spark: SparkSession, d: str) -> DataFrame:
    named = lambda c: F.concat(F.lit("v"), F.col(c).cast("string")).alias("video_id")
    return C.orphans(T.jobs(spark, d).select(named("entity"), "status"), T.sources(spark, d).select(named("source_id")))


@query("get_or_create_lists", "SELECT list_id, created_at FROM lst UNION ALL SELECT 'list' || n_nationkey, 1704067200 FROM nation")
def get_or_create_lists(spark: SparkSession, d: str) -> DataFrame:
    lists = T.lists(spark, d)
    wanted = T.table(spark, d, "nation").select(F.concat(F.lit("list"), F.col("n_nationkey").cast("string")).alias("list_id"), F.lit(T.EPOCH).cast("long").alias("created_at"))
    return C.append_missing(C.append_missing(lists, wanted, "list_id"), wanted, "list_id")


@query(
    "host_platform",
    """SELECT page_id, host, CASE WHEN host = 'example.com' OR host LIKE '%.example.com' THEN 'com' WHEN host = 'example.org' OR host LIKE '%.example.org' THEN 'org'
              WHEN host = 'm.ththth.example.net' OR host LIKE '%.m.ththth.example.net' THEN 'mobile' END AS platform
       FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages)""",
)
def host_platform(spark: SparkSession, d: str) -> DataFrame:
    return C.host_platform(T.table(spark, d, "pages").select("page_id", "url"), DOMAINS).select("page_id", "host", "platform")


@query(
    "selection_reconcile",
    """SELECT source_id, 0 AS part, -source_id AS ord FROM src WHERE list_id = 'src1' AND language = 'en'
       UNION ALL SELECT source_id, 1, source_id FROM src WHERE list_id = 'src1' AND language NOT IN ('en', 'fr')""",
)
def selection_reconcile(spark: SparkSession, d: str) -> DataFrame:
    own = T.sources(spark, d).where("list_id = 'src1'").select("source_id", "language", F.col("source_id").alias("ord"))
    chosen = own.where("language = 'en'").select("source_id", (-F.col("ord")).alias("ord"))
    return C.reconcile_selection(chosen, own, own.where("language IN ('en', 'fr')"))


@query(
    "jobs_merged",
    """SELECT coalesce(a.job_id, b.job_id) AS job_id, coalesce(a.status, b.status) AS status FROM (SELECT job_id, status FROM job WHERE status <> 'failed') a
       FULL JOIN (SELECT job_id, 'tracked' AS status FROM job WHERE status IN ('failed', 'queued')) b ON a.job_id = b.job_id""",
)
def jobs_merged(spark: SparkSession, d: str) -> DataFrame:
    j = T.jobs(spark, d).select("job_id", "status")
    return C.merge_jobs(j.where("status <> 'failed'"), j.where("status IN ('failed', 'queued')").select("job_id", F.lit("tracked").alias("status")))


@query("selected_duration", "SELECT list_id, sum(coalesce(duration_seconds, 0))::BIGINT AS seconds, count(*) AS n FROM src GROUP BY list_id")
def selected_duration(spark: SparkSession, d: str) -> DataFrame:
    return T.sources(spark, d).groupBy("list_id").agg(F.sum(F.coalesce("duration_seconds", F.lit(0))).alias("seconds"), F.count("*").alias("n"))


@query(
    "existing_sources",
    """SELECT DISTINCT j.video_id, list_id, EXISTS (SELECT 1 FROM src s WHERE s.video_id = j.video_id AND s.list_id = l.list_id AND s.season_number = 2) AS present
       FROM job j, (VALUES ('src1'), ('src2'), ('none')) l(list_id)""",
)
def existing_sources(spark: SparkSession, d: str) -> DataFrame:
    """Of the videos that jobs name, in three lists: which are there already as sources of the second season."""
    asked = T.jobs(spark, d).select("video_id", F.explode(F.array(*map(F.lit, ("src1", "src2", "none")))).alias("list_id")).distinct()
    return C.existing(asked, T.sources(spark, d).where("season_number = 2"), ["video_id", "list_id"]).select("video_id", "list_id", "present")


@query("list_video_ids", "SELECT DISTINCT list_id, video_id FROM src WHERE list_id IN (SELECT list_id FROM src WHERE source_id IN (SELECT item_id FROM benchmark))")
def list_video_ids(spark: SparkSession, d: str) -> DataFrame:
    """The set of videos in each list that holds a source asked for."""
    s, asked = T.sources(spark, d), T.table(spark, d, "benchmark").select(F.col("item_id").alias("source_id"))
    return C.by_keys(s, "list_id", C.by_keys(s, "source_id", asked)).select("list_id", "video_id").distinct()
