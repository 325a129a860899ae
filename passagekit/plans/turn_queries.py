"""Registered queries of conversation turns, lists, selections, patches and client state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalog as C
from ..operators import turns as U
from ..sources import store
from ..sources import tables as T
from ..sources.scratch import folder
from .registry import query

CONV = "conv AS (SELECT conv_id AS conversation_id, CASE WHEN conv_id % 6 <> 5 THEN 'src' || (conv_id % 5) END AS list_id, CASE WHEN conv_id % 4 = 1 THEN conv_id * 1000 + max(turn) END AS active_message_id FROM conversations GROUP BY conv_id)"


def conversations(spark: SparkSession, d: str) -> DataFrame:
    """A conversation belongs to a list, but for some; every fourth has an active message, its last."""
    i = F.col("conv_id")
    last = T.table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return last.select(i.alias("conversation_id"), F.when(i % 6 != 5, text("src", i % 5)).alias("list_id"), F.when(i % 4 == 1, i * 1000 + F.col("turn")).alias("active_message_id"))


def text(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


# --- messages ---------------------------------------------------------------------------------------------------------


@query("messages_of_list", f"WITH {CONV} SELECT message_id, list_id FROM msg JOIN conv USING (conversation_id) WHERE list_id = 'src1'")
def messages_of_list(spark: SparkSession, d: str) -> DataFrame:
    return U.of_list(T.messages(spark, d), conversations(spark, d)).where("list_id = 'src1'").select("message_id", "list_id")


@query("savable_messages", f"WITH {CONV} SELECT message_id FROM msg JOIN conv USING (conversation_id) WHERE role = 'assistant' AND status = 'done' AND list_id IS NOT NULL")
def savable_messages(spark: SparkSession, d: str) -> DataFrame:
    return U.savable(T.messages(spark, d), conversations(spark, d)).select("message_id")


@query("history_tail", "SELECT message_id, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, message_id) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, message_id DESC) AS n FROM msg) WHERE n <= 5")
def history_tail(spark: SparkSession, d: str) -> DataFrame:
    return U.tail(T.messages(spark, d), 5).select("message_id", "pos")


REQUESTS = "req AS (SELECT message_id, CASE WHEN message_id % 7 = 0 THEN conversation_id + 1000000 ELSE conversation_id END AS conversation_id, created_at AS asked FROM msg WHERE role = 'user')"


@query(
    "turn_open",
    f"""WITH {CONV}, {REQUESTS} SELECT message_id, CASE WHEN c.conversation_id IS NULL THEN 'missing' WHEN active_message_id IS NOT NULL OR n > 1 THEN 'refused' ELSE 'opened' END AS outcome
        FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY asked, message_id) AS n FROM req) r LEFT JOIN conv c USING (conversation_id)""",
)
def turn_open(spark: SparkSession, d: str) -> DataFrame:
    """User messages ask for turns, some of them in conversations that do not exist."""
    conv = F.when(F.col("message_id") % 7 == 0, F.col("conversation_id") + 1_000_000).otherwise(F.col("conversation_id"))
    asked = T.messages(spark, d).where("role = 'user'").select(conv.alias("conversation_id"), "message_id", F.col("created_at").alias("at"))
    return U.opened(conversations(spark, d), asked).select("message_id", "outcome")


ENDS = "live AS (SELECT message_id, conversation_id, CASE WHEN message_id IN (SELECT active_message_id FROM conv) THEN 'streaming' ELSE status END AS status FROM msg), fin AS (SELECT message_id, CASE WHEN message_id % 2 = 0 THEN 'done' ELSE 'failed' END AS s FROM live WHERE message_id % 3 <> 2)"


def _live(spark: SparkSession, d: str) -> DataFrame:
    """Active messages are still streaming."""
    active = conversations(spark, d).where("active_message_id IS NOT NULL").select(F.col("active_message_id").alias("message_id"))
    return U.flagged(T.messages(spark, d), active, "message_id", "_live").withColumn("status", F.when(F.col("_live"), "streaming").otherwise(F.col("status"))).drop("_live")


@query("turn_end_messages", f"WITH {CONV}, {ENDS} SELECT message_id, CASE WHEN status IN ('done', 'failed', 'needs_auth') THEN status ELSE coalesce(s, status) END AS status FROM live LEFT JOIN fin USING (message_id)")
def turn_end_messages(spark: SparkSession, d: str) -> DataFrame:
    return _ended(spark, d)[1].select("message_id", "status")


@query("turn_end_conversations", f"WITH {CONV}, {ENDS} SELECT conversation_id, CASE WHEN active_message_id NOT IN (SELECT message_id FROM fin) THEN active_message_id END AS active_message_id FROM conv")
def turn_end_conversations(spark: SparkSession, d: str) -> DataFrame:
    return _ended(spark, d)[0].select("conversation_id", "active_message_id")


def _ended(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Turns end with every message but each third; only those under way change."""
    m = _live(spark, d)
    ends = m.where("message_id % 3 != 2").select("message_id", F.when(F.col("message_id") % 2 == 0, "done").otherwise("failed").alias("status"))
    return U.ended(conversations(spark, d), m, ends)


@query(
    "restart_sweep",
    f"""WITH {CONV}, {ENDS} SELECT 'message' AS kind, CASE WHEN status = 'streaming' THEN 'failed' ELSE status END AS status, count(*) AS n FROM live GROUP BY 1, 2
        UNION ALL SELECT 'pointer', 'cleared', count(*) FROM conv UNION ALL SELECT 'job', CASE WHEN status IN ('queued', 'downloading', 'transcribing', 'processing') THEN 'queued' ELSE status END, count(*) FROM job GROUP BY 1, 2""",
)
def restart_sweep(spark: SparkSession, d: str) -> DataFrame:
    c, m, j = U.swept(conversations(spark, d), _live(spark, d), T.jobs(spark, d))
    count = lambda df, kind, status: df.groupBy(F.lit(kind).alias("kind"), status.alias("status")).agg(F.count("*").alias("n"))
    pointer = F.when(F.col("active_message_id").isNull(), "cleared").otherwise("held")
    return count(m, "message", F.col("status")).unionByName(count(c, "pointer", pointer)).unionByName(count(j, "job", F.col("status")))


@query(
    "reference_list",
    """SELECT query_id AS message_id, index, source_id, 'Title ' || source_id AS title FROM (
         SELECT query_id, index, arg_min(source_id, pos) AS source_id FROM (
           SELECT query_id, rank AS pos, index % 3 AS index, CASE WHEN source_id % 5 = 0 THEN source_id + 1000000 ELSE source_id END AS source_id FROM placed JOIN numbered USING (query_id, source_id, section_seq)) GROUP BY ALL)
       WHERE source_id < 1000000""",
)
def reference_list(spark: SparkSession, d: str) -> DataFrame:
    """Numbers are used more than once, and some sources are unknown."""
    placed = _numbered(spark, d)
    source = F.when(F.col("source_id") % 5 == 0, F.col("source_id") + 1_000_000).otherwise(F.col("source_id"))
    cited = placed.select(F.col("query_id").alias("message_id"), F.col("rank").alias("pos"), (F.col("index") % 3).alias("index"), source.alias("source_id"))
    return U.references(cited, T.sources(spark, d))


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.evidence import allocate, chunk_sections
    from .retrieval_queries import retrieved, sections

    placed = chunk_sections(retrieved(spark, d), sections(spark, d))
    return placed.join(allocate(placed).drop("first_rank"), ["query_id", "source_id", "section_seq"])


@query("distinct_citations", "SELECT DISTINCT query_id, index FROM placed JOIN numbered USING (query_id, source_id, section_seq)")
def distinct_citations(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(spark, d).select("query_id", "index").distinct()


@query("sources_with_hits", "SELECT query_id, count(DISTINCT source_id) AS n FROM found GROUP BY query_id")
def sources_with_hits(spark: SparkSession, d: str) -> DataFrame:
    from .retrieval_queries import retrieved

    return retrieved(spark, d).groupBy("query_id").agg(F.countDistinct("source_id").alias("n"))


@query("coverage_by_number", "SELECT query_id, source_id, section_seq, index, row_number() OVER (PARTITION BY query_id ORDER BY index) AS pos FROM numbered")
def coverage_by_number(spark: SparkSession, d: str) -> DataFrame:
    n = _numbered(spark, d).select("query_id", "source_id", "section_seq", "index").distinct()
    return n.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("index")))


@query("index_union", "SELECT query_id, list_sort(list_distinct(list(i))) AS indexes FROM (SELECT query_id, index AS i FROM numbered UNION ALL SELECT query_id, unnest([1, 2, 40]) FROM numbered) GROUP BY query_id")
def index_union(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of chunks and of summaries, each once, in order."""
    own = _numbered(spark, d).groupBy("query_id").agg(F.collect_set("index").alias("i"))
    return own.select("query_id", F.array_sort(F.array_union("i", F.array(*map(F.lit, (1, 2, 40))))).alias("indexes"))


@query("ledger_concat", "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY part, index) AS ord, part, index FROM (SELECT query_id, 0 AS part, index FROM numbered UNION ALL SELECT query_id, 1, index + 10 FROM numbered WHERE index <= 2)")
def ledger_concat(spark: SparkSession, d: str) -> DataFrame:
    """What was retrieved, then what was read, each in its order."""
    n = _numbered(spark, d).select("query_id", "index").distinct()
    both = n.select("query_id", F.lit(0).alias("part"), "index").unionByName(n.where("index <= 2").select("query_id", F.lit(1).alias("part"), (F.col("index") + 10).alias("index")))
    return both.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("part", "index")).alias("ord"), "part", "index")


@query("dump_flags", "SELECT message_id, message_id % 3 = 0 AS has_dump FROM msg WHERE role = 'assistant'")
def dump_flags(spark: SparkSession, d: str) -> DataFrame:
    """Every third turn is dumped as a JSON document; the messages are flagged by what is there."""
    path = folder(spark, "dumps") + "/json"
    m = T.messages(spark, d).where("role = 'assistant'")
    store.write_documents(m.where("message_id % 3 = 0").select("message_id", "content"), path)
    return U.flagged(m.select("message_id"), store.read_documents(spark, path, "message_id long, content string", "message_id"), "message_id", "has_dump")


@query(
    "buffered_events",
    """SELECT event_id, kind, CASE WHEN kind IN ('text', 'error') THEN coalesce(content, '') END AS content, CASE WHEN kind = 'citation' THEN coalesce(index, 0) END AS index, CASE WHEN kind IN ('tool_start', 'tool_end') THEN 'tool' END AS name
       FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'text' WHEN 'click' THEN 'citation' WHEN 'purchase' THEN 'tool_end' WHEN 'error' THEN 'error' ELSE 'usage' END AS kind, CASE WHEN event_id % 3 > 0 THEN props END AS content, CASE WHEN event_id % 2 = 0 THEN user_id END AS index FROM events) WHERE kind <> 'usage'""",
)
def buffered_events(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    kind = F.when(t == "view", "text").when(t == "click", "citation").when(t == "purchase", "tool_end").when(t == "error", "error").otherwise("usage")
    i = F.col("event_id")
    e = T.table(spark, d, "events").select(i.alias("message_id"), F.lit(0).alias("pos"), kind.alias("kind"), F.when(i % 3 > 0, F.col("props")).alias("content"), F.when(i % 2 == 0, F.col("user_id")).alias("index"), F.lit(None).cast("string").alias("name"))
    return U.projected(e).select(F.col("message_id").alias("event_id"), "kind", "content", "index", "name")


@query("flattened_messages", "SELECT conversation_id, md5('You answer from passages.' || chr(10) || string_agg(content, chr(10) ORDER BY turn) FILTER (WHERE content <> '') || chr(10) || 'find_passages(query)') AS text_md5 FROM msg GROUP BY conversation_id")
def flattened_messages(spark: SparkSession, d: str) -> DataFrame:
    contents = F.transform(F.array_sort(F.collect_list(F.struct("turn", "content"))), lambda x: x["content"])
    m = T.messages(spark, d).groupBy("conversation_id").agg(contents.alias("c"))
    return m.select("conversation_id", F.md5(U.flattened(F.lit("You answer from passages."), F.col("c"), F.array(F.lit("find_passages(query)")))).alias("text_md5"))


@query("tool_errors", "SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click') THEN 'unknown tool' WHEN event_type = 'view' AND event_id % 4 = 0 THEN 'empty query' WHEN event_type = 'click' AND event_id % 5 = 0 THEN 'empty section' END AS error FROM events")
def tool_errors(spark: SparkSession, d: str) -> DataFrame:
    t, i = F.col("event_type"), F.col("event_id")
    name = F.when(t == "view", "find_passages").when(t == "click", "read_section").otherwise(t)
    e = T.table(spark, d, "events").select(i.alias("event_id"), name.alias("name"), F.when(i % 4 == 0, " ").otherwise("words").alias("query"), F.when(i % 5 != 0, "[1]").alias("section"))
    return U.tool_errors(e, ["find_passages", "read_section"]).select("event_id", "error")


@query(
    "tool_rounds",
    """WITH r AS (SELECT doc_id AS message_id, n AS round, CASE WHEN n <= doc_id % 5 THEN 1 ELSE 0 END AS n_calls, CASE WHEN (doc_id + n) % 3 = 0 THEN ' ' ELSE 'answer ' || n END AS answer FROM documents, (SELECT unnest([1, 2, 3, 4, 5]) AS n)),
       fin AS (SELECT message_id, min(round) AS round FROM r WHERE n_calls = 0 OR round > 3 GROUP BY message_id)
       SELECT f.message_id, f.round - 1 AS tool_rounds, trim(a.answer) = '' OR f.round > 3 AS forced, coalesce(nullif(trim(a.answer), ''), nullif(trim(b.answer), '')) AS answer,
              CASE WHEN coalesce(nullif(trim(a.answer), ''), nullif(trim(b.answer), '')) IS NULL THEN 'empty answer' END AS error
       FROM fin f JOIN r a USING (message_id, round) LEFT JOIN r b ON b.message_id = f.message_id AND b.round = f.round + 1""",
)
def tool_rounds(spark: SparkSession, d: str) -> DataFrame:
    i, n = F.col("doc_id"), F.col("round")
    r = T.table(spark, d, "documents").select("doc_id", F.explode(F.array(*map(F.lit, (1, 2, 3, 4, 5)))).alias("round"))
    r = r.select(i.alias("message_id"), "round", F.when(n <= i % 5, 1).otherwise(0).alias("n_calls"), F.when((i + n) % 3 == 0, " ").otherwise(text("answer ", n)).alias("answer"))
    return U.tool_rounds(r)


@query(
    "history_rows",
    """SELECT message_id, CASE WHEN message_id % 3 = 0 THEN role || content WHEN message_id % 3 = 1 THEN coalesce(content, '') ELSE '' END AS shown, CASE WHEN status = 'failed' THEN CASE WHEN message_id % 2 = 0 THEN 'timeout' ELSE 'error' END END AS label FROM msg""",
)
def history_rows(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("message_id")
    m = T.messages(spark, d).withColumn("blocks", F.when(i % 3 == 0, F.array("role", "content")).otherwise(F.array().cast("array<string>")))
    m = m.withColumn("content", F.when(i % 3 != 2, F.col("content"))).withColumn("error", F.when(i % 2 == 0, "timeout").otherwise(""))
    return U.history_rows(m)


# --- lists and sources -------------------------------------------------------------------------------------------------


@query("artifacts_of_list", "SELECT list_id, artifact_id, row_number() OVER (PARTITION BY list_id ORDER BY created_at DESC, artifact_id DESC) AS pos FROM (SELECT item_id AS artifact_id, 'src' || (item_id % 5) AS list_id, 1704067200 + item_id * 37 % 1000 AS created_at FROM benchmark)")
def artifacts_of_list(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    a = T.table(spark, d, "benchmark").select(i.alias("artifact_id"), text("src", i % 5).alias("list_id"), (F.lit(T.EPOCH) + i * 37 % 1000).alias("created_at"))
    w = Window.partitionBy("list_id").orderBy(F.desc("created_at"), F.desc("artifact_id"))
    return a.select("list_id", "artifact_id", F.row_number().over(w).alias("pos"))


@query("lists_sorted", "SELECT list_id, row_number() OVER (ORDER BY updated_at DESC, created_at DESC, list_id) AS pos FROM (SELECT list_id, any_value(l.created_at) AS created_at, coalesce(max(processed_at), any_value(l.created_at)) AS updated_at FROM lst l LEFT JOIN src USING (list_id) GROUP BY list_id)")
def lists_sorted(spark: SparkSession, d: str) -> DataFrame:
    out = C.list_display(T.lists(spark, d), T.sources(spark, d))
    return C.numbered(out, [F.desc("updated_at"), F.desc("created_at"), F.asc("list_id")], "pos").select("list_id", "pos")


@query("pool_sizes", "SELECT list_id, least(greatest(count(*) * 3, 8, 10), 60) AS size FROM src GROUP BY list_id")
def pool_sizes(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.retrieval import pool_size

    return T.sources(spark, d).groupBy("list_id").agg(pool_size(F.count("*"), 8).alias("size"))


@query("source_cap", "SELECT list_id, source_id FROM (SELECT list_id, source_id, row_number() OVER (PARTITION BY list_id ORDER BY processed_at, source_id) AS n FROM src) WHERE n <= 10")
def source_cap(spark: SparkSession, d: str) -> DataFrame:
    """The first ten sources of each list, which is as many as an evaluation set reads."""
    w = Window.partitionBy("list_id").orderBy("processed_at", "source_id")
    return T.sources(spark, d).withColumn("_n", F.row_number().over(w)).where("_n <= 10").select("list_id", "source_id")


COVER = "cov AS (SELECT *, CASE WHEN source_id % 4 = 0 THEN '/covers/' || source_id || '.jpg' END AS cover_path, CASE WHEN source_id % 3 = 0 THEN 'https://img/' || source_id END AS cover_url FROM src)"


def _covers(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("source_id")
    return T.sources(spark, d).withColumn("cover_path", F.when(i % 4 == 0, F.concat(text("/covers/", i), F.lit(".jpg")))).withColumn("cover_url", F.when(i % 3 == 0, text("https://img/", i)))


@query("list_thumbnails", f"WITH {COVER} SELECT l.list_id, coalesce(cover_path, '/proxy?url=' || cover_url) AS thumbnail FROM lst l LEFT JOIN (SELECT list_id, min(source_id) AS source_id FROM src GROUP BY list_id) USING (list_id) LEFT JOIN cov ON cov.source_id = (SELECT min(source_id) FROM src s WHERE s.list_id = l.list_id)")
def list_thumbnails(spark: SparkSession, d: str) -> DataFrame:
    """The first source's own cover, else its cover from elsewhere, else nothing."""
    first = _covers(spark, d).groupBy("list_id").agg(F.min_by(F.struct("cover_path", "cover_url"), "source_id").alias("c"))
    shown = F.coalesce("c.cover_path", F.concat(F.lit("/proxy?url="), F.col("c.cover_url")))
    return T.lists(spark, d).join(first, "list_id", "left").select("list_id", shown.alias("thumbnail"))


@query("first_source_thumbnail", f"WITH {COVER} SELECT l.list_id, coalesce(CASE WHEN l.list_id = 'src2' THEN 'own' END, arg_min(cover_url, source_id) FILTER (WHERE cover_url IS NOT NULL)) AS thumbnail FROM lst l LEFT JOIN cov ON cov.list_id = l.list_id GROUP BY l.list_id")
def first_source_thumbnail(spark: SparkSession, d: str) -> DataFrame:
    """A list without a thumbnail takes that of its first source that has one."""
    lists = T.lists(spark, d).withColumn("thumbnail", F.when(F.col("list_id") == "src2", "own"))
    first = _covers(spark, d).where("cover_url IS NOT NULL").groupBy("list_id").agg(F.min_by("cover_url", "source_id").alias("_c"))
    return lists.join(first, "list_id", "left").select("list_id", F.coalesce("thumbnail", "_c").alias("thumbnail"))


@query("title_fallback", "SELECT source_id, coalesce(CASE WHEN source_id % 3 = 0 THEN 'hit ' || source_id END, CASE WHEN source_id % 5 <> 0 THEN title END, '') AS title FROM src")
def title_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Titles that retrieval gave, then the catalog's, then none."""
    s, i = T.sources(spark, d), F.col("source_id")
    hits = s.where(i % 3 == 0).select("source_id", text("hit ", i).alias("_h"))
    known = s.where(i % 5 != 0).select("source_id", F.col("title").alias("_t"))
    return s.select("source_id").join(hits, "source_id", "left").join(known, "source_id", "left").select("source_id", F.coalesce("_h", "_t", F.lit("")).alias("title"))


@query("selected_sources", "SELECT n_nationkey AS request_id, unnest([n_nationkey, n_nationkey + 1]) AS source_id FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT n_nationkey, source_id FROM nation JOIN src ON list_id = 'src' || (n_nationkey % 5) WHERE n_nationkey % 3 <> 0")
def selected_sources(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("n_nationkey").cast("long")
    ids = F.when(i % 3 == 0, F.array(i, i + 1)).when(i % 3 == 1, F.array().cast("array<bigint>"))
    asked = T.table(spark, d, "nation").select(i.alias("request_id"), text("src", i % 5).alias("list_id"), ids.alias("source_ids"))
    return U.selection(asked, T.sources(spark, d))


@query(
    "patched_lists",
    """SELECT list_id, list_id = 'src1' AS refused, CASE list_id WHEN 'src0' THEN 'New name' ELSE 'Name ' || list_id END AS name, CASE WHEN list_id IN ('src0', 'src1', 'src3') THEN 'old' WHEN list_id = 'src2' THEN NULL ELSE 'old' END AS note FROM lst""",
)
def patched_lists(spark: SparkSession, d: str) -> DataFrame:
    """A name, a blank name, a note set to null, a field that lists do not have."""
    base = T.lists(spark, d).select("list_id", F.concat(F.lit("Name "), "list_id").alias("name"), F.lit("old").alias("note"))
    patches = spark.createDataFrame([("src0", '{"name": " New name "}'), ("src1", '{"name": " ", "note": "x"}'), ("src2", '{"note": null}'), ("src3", '{"colour": "red"}')], "list_id string, patch string")
    return U.patched(base, patches, "list_id", ["name", "note"], ["name"]).select("list_id", "refused", "name", "note")


@query("section_summaries", "SELECT source_id, section_seq, CASE WHEN section_seq % 2 = 0 THEN 'Summary ' || section_seq END AS summary FROM section")
def section_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Summaries by source and number; those of sections that are not there change nothing."""
    from .retrieval_queries import sections

    s = sections(spark, d).select("source_id", "section_seq", F.concat_ws(":", "source_id", "section_seq").alias("key"), F.lit(None).cast("string").alias("summary"))
    given = s.where("section_seq % 2 = 0").select(F.col("key"), text("Summary ", F.col("section_seq")).alias("summary"))
    absent = s.select(F.concat("key", F.lit(":none")).alias("key"), F.lit("nowhere").alias("summary"))
    return C.update_present(s, given.unionByName(absent), "key", "summary").select("source_id", "section_seq", "summary")


@query("job_inserts", "SELECT job_id, status, progress FROM (SELECT job_id, status, 50 AS progress FROM job UNION ALL SELECT -doc_id - 1, 'queued', 0 FROM documents)")
def job_inserts(spark: SparkSession, d: str) -> DataFrame:
    """New jobs are queued and have made no progress; ids that are there already change nothing."""
    base = T.jobs(spark, d).select("job_id", "status", F.lit(50).alias("progress"))
    new = T.table(spark, d, "documents").select((-F.col("doc_id") - 1).alias("job_id"), F.lit("queued").alias("status"), F.lit(0).alias("progress"))
    return C.append_missing(base, new.unionByName(base.withColumn("status", F.lit("queued"))), "job_id")


@query("conversation_get_or_create", f"WITH {CONV} SELECT conversation_id, coalesce(c.list_id, CASE WHEN c.conversation_id IS NULL THEN 'new' END) AS list_id FROM (SELECT DISTINCT doc_id AS conversation_id FROM documents UNION SELECT conversation_id FROM conv) LEFT JOIN conv c USING (conversation_id)")
def conversation_get_or_create(spark: SparkSession, d: str) -> DataFrame:
    asked = T.table(spark, d, "documents").select(F.col("doc_id").alias("conversation_id"), F.lit("new").alias("list_id")).distinct()
    return C.append_missing(conversations(spark, d).select("conversation_id", "list_id"), asked, "conversation_id")


@query("compaction_write", "SELECT conversation_id, CASE WHEN n > 4 THEN 'summary of ' || (n - 2) END AS summary, CASE WHEN n > 4 THEN 2 + bad ELSE n + bad END AS n_left FROM (SELECT conversation_id, count(*) FILTER (WHERE status = 'done') AS n, count(*) FILTER (WHERE status <> 'done') AS bad FROM msg GROUP BY conversation_id)")
def compaction_write(spark: SparkSession, d: str) -> DataFrame:
    """Old messages go and their conversation gets a summary in their place, in one step of two tables."""
    m = T.messages(spark, d)
    left = C.compact(m, 4, 2)
    gone = m.join(left.select("message_id"), "message_id", "left_anti").groupBy("conversation_id").agg(text("summary of ", F.count("*")).alias("summary"))
    n = left.groupBy("conversation_id").agg(F.count("*").alias("n_left"))
    return n.join(gone, "conversation_id", "left").select("conversation_id", "summary", "n_left")


# --- jobs and models ---------------------------------------------------------------------------------------------------


ACTIVE_SQL = "('queued', 'downloading', 'transcribing', 'processing')"


@query("digest_guard", f"SELECT source_id, source_id IN (SELECT json_extract(meta, '$.k')::BIGINT FROM job WHERE status IN {ACTIVE_SQL}) AS refused FROM src")
def digest_guard(spark: SparkSession, d: str) -> DataFrame:
    """A source with an active job that names it in its metadata gets no second one."""
    busy = T.jobs(spark, d).where(F.col("status").isin(C.ACTIVE)).select(F.get_json_object("meta", "$.k").cast("long").alias("source_id"))
    return U.flagged(T.sources(spark, d).select("source_id"), busy, "source_id", "refused")


@query("no_speech", "SELECT source_id, CASE WHEN source_id % 7 = 0 THEN 'cancelled' WHEN source_id NOT IN (SELECT source_id FROM seg) THEN 'no speech' ELSE 'ok' END AS outcome FROM src")
def no_speech(spark: SparkSession, d: str) -> DataFrame:
    s = U.flagged(T.sources(spark, d).select("source_id"), T.segments(spark, d), "source_id", "spoken")
    return s.select("source_id", F.when(F.col("source_id") % 7 == 0, "cancelled").when(~F.col("spoken"), "no speech").otherwise("ok").alias("outcome"))


@query("jobs_of_context", "SELECT job_id FROM job WHERE meta LIKE '%\"k\": 1%' AND entity % 2 = 0")
def jobs_of_context(spark: SparkSession, d: str) -> DataFrame:
    """Jobs by producer and by what their metadata begins with."""
    return T.jobs(spark, d).where(F.get_json_object("meta", "$.k").startswith("1") & (F.col("entity") % 2 == 0)).select("job_id")


@query("digest_jobs_of_source", "SELECT json_extract(meta, '$.k')::BIGINT AS source_id, count(*) AS n FROM job WHERE status <> 'failed' GROUP BY 1")
def digest_jobs_of_source(spark: SparkSession, d: str) -> DataFrame:
    j = T.jobs(spark, d).where("status != 'failed'").select(F.get_json_object("meta", "$.k").cast("long").alias("source_id"))
    return j.groupBy("source_id").agg(F.count("*").alias("n"))


@query("newly_terminal", "SELECT job_id FROM job WHERE status IN ('done', 'failed', 'needs_auth') AND job_id % 3 = 0")
def newly_terminal(spark: SparkSession, d: str) -> DataFrame:
    """Before, every third job was still under way."""
    j = T.jobs(spark, d)
    before = j.withColumn("status", F.when(F.col("job_id") % 3 == 0, "processing").otherwise(F.col("status")))
    return U.newly_terminal(j, before).select("job_id")


@query("status_sets", "SELECT entity, list_sort(list_filter(s, lambda x: x NOT IN ('done', 'failed', 'needs_auth'))) AS active, list_sort(list_filter(s, lambda x: x IN ('done', 'failed', 'needs_auth'))) AS terminal FROM (SELECT entity, list(DISTINCT status) AS s FROM job GROUP BY entity)")
def status_sets(spark: SparkSession, d: str) -> DataFrame:
    ended = F.array(*map(F.lit, C.TERMINAL))
    s = T.jobs(spark, d).groupBy("entity").agg(F.collect_set("status").alias("s"))
    return s.select("entity", F.array_sort(F.array_except("s", ended)).alias("active"), F.array_sort(F.array_intersect("s", ended)).alias("terminal"))


@query("model_sync", "SELECT n_nationkey AS model, CASE WHEN n_regionkey < 2 AND n_nationkey % 3 <> 0 THEN 'queued' ELSE 'skipped' END AS decision FROM nation")
def model_sync(spark: SparkSession, d: str) -> DataFrame:
    """Models that are required and not installed are queued."""
    n = T.table(spark, d, "nation").select(F.col("n_nationkey").alias("model"), (F.col("n_regionkey") < 2).alias("required"))
    have = U.flagged(n, n.where("model % 3 = 0").select("model"), "model", "have")
    return have.select("model", F.when(F.col("required") & ~F.col("have"), "queued").otherwise("skipped").alias("decision"))


@query("model_order", "SELECT n_nationkey AS model, row_number() OVER (ORDER BY n_regionkey, (n_nationkey % 3 = 0) DESC, n_nationkey) AS pos FROM nation")
def model_order(spark: SparkSession, d: str) -> DataFrame:
    """By kind, then required ones first."""
    n = T.table(spark, d, "nation").select(F.col("n_nationkey").alias("model"), "n_regionkey", (F.col("n_nationkey") % 3 == 0).alias("required"))
    return C.numbered(n, [F.asc("n_regionkey"), F.desc("required"), F.asc("model")], "pos").select("model", "pos")


@query("pending_deletions", "SELECT entity AS scope, list_sort(list(video_id)) AS pending FROM (SELECT entity, video_id, arg_max(a, (updated_at, a)) AS a FROM (SELECT entity, video_id, updated_at, CASE WHEN job_id % 3 = 0 THEN 'settle' ELSE 'start' END AS a FROM (SELECT entity, 'v' || (job_id % 5) AS video_id, updated_at, job_id FROM job)) GROUP BY ALL) WHERE a = 'start' GROUP BY entity")
def pending_deletions(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("job_id")
    a = T.jobs(spark, d).select(F.col("entity").alias("scope"), text("v", i % 5).alias("id"), F.col("updated_at").alias("at"), F.when(i % 3 == 0, "settle").otherwise("start").alias("action"))
    return U.pending_deletions(a)


@query("cancelled_jobs", "SELECT job_id, count(*) FILTER (WHERE c IS NULL OR s * 10 <= c)::INT AS stages_run, CASE WHEN bool_or(s * 10 > c) THEN ['cleanup', 'delete'] ELSE [] END AS then FROM (SELECT job_id, CASE WHEN job_id % 3 = 0 THEN job_id % 50 END AS c, unnest([1, 2, 3, 4]) AS s FROM job) GROUP BY job_id")
def cancelled_jobs(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("job_id")
    s = T.jobs(spark, d).select("job_id", F.when(i % 3 == 0, i % 50).alias("cancel_at"), F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("stage"))
    return U.cancelled(s.withColumn("at", F.col("stage") * 10))


# --- settings -----------------------------------------------------------------------------------------------------------


@query("profile_defaults", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'm' || n_nationkey ELSE 'base' END AS model, CASE WHEN n_nationkey % 2 = 0 THEN '0.5' ELSE '1' END AS temperature FROM nation")
def profile_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Known keys stay, others go, blank values are the defaults'."""
    i = F.col("n_nationkey")
    raw = F.create_map(F.lit("model"), F.when(i % 3 == 0, text("m", i)).otherwise(" "), F.lit("colour"), F.lit("red"), F.lit("temperature"), F.when(i % 2 == 0, "0.5"))
    kept = X.with_defaults(raw, {"model": "base", "temperature": "1"})
    return T.table(spark, d, "nation").select("n_nationkey", kept["model"].alias("model"), kept["temperature"].alias("temperature"))


@query("llm_overrides", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'own' ELSE 'base' END AS model, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 10 ELSE 7 END AS budget FROM customer")
def llm_overrides(spark: SparkSession, d: str) -> DataFrame:
    """An empty field is an unset one."""
    i = F.col("c_custkey")
    own = F.when(i % 3 == 0, "own").when(i % 3 == 1, "")
    return T.table(spark, d, "customer").select("c_custkey", F.coalesce(F.nullif(own, F.lit("")), F.lit("base")).alias("model"), F.coalesce(F.when(i % 4 == 0, i % 10), F.lit(7)).alias("budget"))


@query("unmasked_patches", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'old' || c_custkey ELSE 'new' || c_custkey END AS token FROM customer")
def unmasked_patches(spark: SparkSession, d: str) -> DataFrame:
    """A value that is masked never overwrites what it masks."""
    i = F.col("c_custkey")
    patch = F.when(i % 6 == 0, "***").when(i % 3 == 0, "abcd...wxyz").otherwise(F.concat(F.lit("  "), text("new", i), F.lit(" ")))
    return T.table(spark, d, "customer").select("c_custkey", X.unmasked(text("old", i), patch).alias("token"))
