"""Catalog and state: scans, upserts, cascades, job and conversation state, all as DataFrame plans.

Writes are expressed as the table that results; the caller stores it (Parquet has no update in place).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ["queued", "downloading", "transcribing", "processing"]
TERMINAL = ["done", "failed", "needs_auth"]


# --- scans ---------------------------------------------------------------------------------------------------------


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """At most one row by key."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def by_keys(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key is among those given; none for no keys."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def existing(asked: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows asked for, each with whether df has any row of the same keys; a null key is the key of no row."""
    held = df.select(*keys).distinct().withColumn("present", F.lit(True))
    return asked.join(held, keys, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def pending_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin(ACTIVE)).orderBy("updated_at", "job_id")


def jobs_with_meta(jobs: DataFrame, path: str, value: str, active: bool = True) -> DataFrame:
    """Jobs whose JSON metadata has a value at a path."""
    found = jobs.where(F.get_json_object("meta", path) == value)
    return found.where(F.col("status").isin(ACTIVE)) if active else found


def activity() -> list[Column]:
    """Unfinished jobs first, then the latest."""
    return [F.col("status").isin(TERMINAL).cast("int").asc(), F.desc("updated_at"), F.asc("job_id")]


def activity_order(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(*activity())


def host_platform(urls: DataFrame, domains: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """The platform of the first registered domain that is a url's host or its suffix; null if none is."""
    host = F.lower(F.parse_url(F.col(url), F.lit("HOST")))
    case = F.lit(None).cast("string")
    for domain, platform in reversed(domains):
        case = F.when((host == domain) | host.endswith("." + domain), platform).otherwise(case)
    return urls.withColumn("host", host).withColumn("platform", case)


def truncation_status(decoded: Column, container: Column, expected: Column, least: float = 0.9) -> Column:
    """Whether decoded audio reaches nine tenths of each length known for it; unverified where none is known."""
    known = lambda x: F.coalesce(x, F.lit(0)) > 0
    short = lambda x: known(x) & (F.coalesce(decoded, F.lit(0)) < x * least)
    return F.when(~known(container) & ~known(expected), "unverified").when(short(container) | short(expected), "truncated").otherwise("ok")


# --- joins over the catalog ----------------------------------------------------------------------------------------


def facet_scope(pool: DataFrame, **facets: object) -> DataFrame:
    """Sources whose facets equal all those given; if none does, the whole pool, marked as such.

    Null facets never match.  Without facets the pool itself, matched_count null.
    """
    asked = [F.col(k) == F.lit(v) for k, v in facets.items() if v is not None]
    if not asked:
        return pool.withColumn("matched_count", F.lit(None).cast("long")).withColumn("no_match", F.lit(False))
    hit = asked[0]
    for x in asked[1:]:
        hit = hit & x
    flagged = pool.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    count = flagged.agg(F.count_if("_hit").alias("matched_count"))  # one row
    scoped = flagged.crossJoin(F.broadcast(count)).where(F.col("_hit") | (F.col("matched_count") == 0))
    return scoped.withColumn("no_match", F.col("matched_count") == 0).drop("_hit")


def video_statuses(ids: DataFrame, jobs: DataFrame, processed: DataFrame, key: str = "video_id") -> DataFrame:
    """needs_auth before in_progress before processed before new; finished and failed jobs count for nothing."""
    state = jobs.groupBy(key).agg(F.bool_or(F.col("status") == "needs_auth").alias("auth"), F.bool_or(F.col("status").isin(ACTIVE)).alias("busy"))
    done = processed.select(key).distinct().withColumn("have", F.lit(True))
    status = F.when(F.col("auth"), "needs_auth").when(F.col("busy"), "in_progress").when(F.col("have"), "processed").otherwise("new")
    return ids.join(state, key, "left").join(done, key, "left").select(*ids.columns, status.alias("status"))


def list_display(lists: DataFrame, sources: DataFrame) -> DataFrame:
    """Each list with its latest change and its number of sources; lists without any stay."""
    per = sources.groupBy("list_id").agg(F.max("processed_at").alias("latest"), F.count("*").alias("n"))
    out = lists.join(per, "list_id", "left")
    return out.select("list_id", "created_at", F.coalesce("latest", "created_at").alias("updated_at"), F.coalesce("n", F.lit(0)).cast("long").alias("video_count"))


def orphans(jobs: DataFrame, sources: DataFrame, key: str = "video_id") -> DataFrame:
    """Entities with an unfinished ingest and no committed source: their files may go."""
    return jobs.where(F.col("status") != "done").select(key).distinct().join(sources.select(key), key, "left_anti")


def merge_jobs(server: DataFrame, tracked: DataFrame) -> DataFrame:
    """Jobs known to either side; the server's state wins."""
    t = tracked.select("job_id", *(F.col(c).alias(f"_{c}") for c in tracked.columns if c != "job_id"))
    both = [F.coalesce(c, f"_{c}").alias(c) if c in tracked.columns else F.col(c) for c in server.columns if c != "job_id"]
    return server.join(t, "job_id", "full").select("job_id", *both)


def reconcile_selection(selected: DataFrame, current: DataFrame, known: DataFrame, key: str = "source_id") -> DataFrame:
    """Selected ids that still exist in their order, then ids never seen before in theirs; ``ord`` orders both inputs."""
    kept = selected.join(current.select(key), key, "left_semi").select(key, F.lit(0).alias("part"), "ord")
    new = current.join(known.select(key), key, "left_anti").select(key, F.lit(1).alias("part"), "ord")
    return kept.unionByName(new)


# --- conversations -------------------------------------------------------------------------------------------------


def newest_first(order: list[str]) -> list[Column]:
    return [F.desc(c) for c in order]


def keyset_page(messages: DataFrame, before: object, limit: int) -> DataFrame:
    """The newest messages of each conversation before an anchor message, oldest first; an unknown anchor gives none."""
    anchor = messages.where(F.col("message_id") == F.lit(before)).select(F.col("conversation_id"), F.struct("created_at", "message_id").alias("anchor"))
    page = messages.join(anchor, "conversation_id").where(F.struct("created_at", "message_id") < F.col("anchor")).drop("anchor")
    return page.orderBy(*newest_first(["created_at", "message_id"])).limit(limit).orderBy("created_at", "message_id")


def prior_prompt(messages: DataFrame) -> DataFrame:
    """Each assistant message with the latest user message before it in its conversation."""
    w = Window.partitionBy("conversation_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    user = lambda c: F.last(F.when(F.col("role") == "user", F.col(c)), ignorenulls=True).over(w)
    return messages.withColumn("prompt_id", user("message_id")).withColumn("prompt", user("content")).where("role = 'assistant'").select("message_id", "prompt_id", "prompt")


def beyond_window(messages: DataFrame, keep: int) -> DataFrame:
    """Finished messages older than the newest ``keep`` of their conversation."""
    w = Window.partitionBy("conversation_id").orderBy(*newest_first(["created_at", "message_id"]))
    return messages.where("status = 'done'").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") > keep).drop("_rn")


def compact(messages: DataFrame, threshold: int, keep: int) -> DataFrame:
    """What stays of the messages when conversations of more than ``threshold`` finished ones keep the newest ``keep``."""
    long = messages.where("status = 'done'").groupBy("conversation_id").count().where(F.col("count") > threshold)
    old = beyond_window(messages, keep).join(long, "conversation_id", "left_semi")
    return messages.join(old.select("message_id"), "message_id", "left_anti")


# --- state -----------------------------------------------------------------------------------------------------------


def latest_state(events: DataFrame, key: str, order: list[str], *columns: str) -> DataFrame:
    """The last state of each key: one aggregation, no sort."""
    at = F.struct(*order)
    return events.groupBy(key).agg(*(F.max_by(c, at).alias(c) for c in columns))


def upsert(base: DataFrame, staged: DataFrame, keys: list[str], keep_old: list[str], prefer_new: list[str]) -> DataFrame:
    """Rows of both tables by key: old ``keep_old`` columns where there are any, new ``prefer_new`` ones unless null, all others as staged."""
    n = staged.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in staged.columns if c not in keys), F.lit(True).alias("_new"))
    out = []
    for c in base.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in keep_old:
            out.append(F.coalesce(c, f"_n_{c}").alias(c))
        elif c in prefer_new:
            out.append(F.coalesce(f"_n_{c}", c).alias(c))
        else:
            out.append(F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
    return base.join(n, keys, "full").select(*out)


def update_present(base: DataFrame, patch: DataFrame, key: str, column: str) -> DataFrame:
    """Replace a column where the patch has the key, by null too; keys that base lacks change nothing."""
    p = patch.select(key, F.col(column).alias("_v"), F.lit(True).alias("_p"))
    return base.join(p, key, "left").select(*(F.when(F.col("_p"), F.col("_v")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in base.columns))


def delete_cascade(parents: DataFrame, children: dict[str, DataFrame], key: str, gone: DataFrame) -> dict[str, DataFrame]:
    """Parents and children without the rows of deleted keys."""
    keys = gone.select(key).distinct()
    return {"parents": parents.join(keys, key, "left_anti")} | {n: c.join(keys, key, "left_anti") for n, c in children.items()}


def append_missing(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Insert rows whose key is new; others change nothing."""
    return base.unionByName(rows.join(base.select(key), key, "left_anti"))


def merge_json(base: Column, patch: Column) -> Column:
    """Shallow merge of two JSON objects of plain values; the patch wins."""
    kind = "map<string,string>"
    a, b = F.from_json(base, kind), F.from_json(patch, kind)
    left = F.map_filter(F.coalesce(a, F.create_map().cast(kind)), lambda k, _: ~F.coalesce(F.map_contains_key(b, k), F.lit(False)))
    return F.to_json(F.map_concat(left, F.coalesce(b, F.create_map().cast(kind))))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with each row's place in an order over all rows, from 1.

    Rows are dealt by ranges of the order and numbered there; each range adds what stands before it, so no task holds all.
    """
    from ..sources.stored import once

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    held = once(ranged, "numbered")
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a row for each range
    before = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    return held.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("int")).drop("_part", "_at", "_n", "_first", "_before")
