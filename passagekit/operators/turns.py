"""Conversation turns: opening and ending them, their history, references, flags and what is sent to a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import ACTIVE, TERMINAL

#: Event kinds that a replay buffer keeps.
BUFFERED = ["text", "citation", "tool_start", "tool_end", "error"]
#: Names of languages in themselves, by code; others count as English.
LANGUAGES = {"en": "English", "zh": "中文", "de": "Deutsch", "fr": "Français", "es": "Español", "ja": "日本語"}


def of_list(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Messages with the list of their conversation; those without a conversation go."""
    return messages.join(conversations.select("conversation_id", "list_id"), "conversation_id")


def savable(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Messages that may be kept as artifacts: finished ones of the assistant, in some list."""
    return of_list(messages, conversations).where("role = 'assistant' AND status = 'done' AND list_id IS NOT NULL")


def tail(messages: DataFrame, n: int, by: str = "conversation_id") -> DataFrame:
    """The last n messages of each conversation, numbered from the oldest of them."""
    newest = Window.partitionBy(by).orderBy(F.desc("created_at"), F.desc("message_id"))
    kept = messages.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n)
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy("created_at", "message_id"))).drop("_n")


def opened(conversations: DataFrame, requests: DataFrame) -> DataFrame:
    """What becomes of requests (conversation_id, message_id, at) to open a turn.

    A conversation with an active stream refuses all; of several requests the first opens the turn, the others are
    refused; unknown conversations are missing.
    """
    first = Window.partitionBy("conversation_id").orderBy("at", "message_id")
    asked = requests.withColumn("_n", F.row_number().over(first)).join(conversations.select("conversation_id", "active_message_id", F.lit(True).alias("_known")), "conversation_id", "left")
    state = F.when(F.col("_known").isNull(), "missing").when(F.col("active_message_id").isNotNull() | (F.col("_n") > 1), "refused").otherwise("opened")
    return asked.select("conversation_id", "message_id", "at", state.alias("outcome"))


def ended(conversations: DataFrame, messages: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables when turns end (message_id, status): the message takes its status unless it has a terminal one, and
    the conversation's pointer is cleared if it names that message."""
    e = ends.select("message_id", F.col("status").alias("_s")).dropDuplicates(["message_id"])
    m = messages.join(e, "message_id", "left").withColumn("status", F.when(~F.col("status").isin(TERMINAL), F.coalesce("_s", "status")).otherwise(F.col("status"))).select(*messages.columns)
    gone = e.select(F.col("message_id").alias("active_message_id"), F.lit(True).alias("_ended"))
    c = conversations.join(gone, "active_message_id", "left").withColumn("active_message_id", F.when(F.col("_ended").isNull(), F.col("active_message_id"))).select(*conversations.columns)
    return c, m


def swept(conversations: DataFrame, messages: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables after a restart: messages under way have failed, pointers are cleared, jobs under way are queued."""
    m = messages.withColumn("status", F.when(F.col("status") == "streaming", "failed").otherwise(F.col("status")))
    c = conversations.withColumn("active_message_id", F.lit(None).cast(conversations.schema["active_message_id"].dataType))
    j = jobs.withColumn("status", F.when(F.col("status").isin(ACTIVE), "queued").otherwise(F.col("status")))
    return c, m, j


def references(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Each message's sources by citation number (message_id, pos, index, source_id): the first use of a number counts,
    unknown sources go."""
    first = citations.groupBy("message_id", "index").agg(F.min_by("source_id", "pos").alias("source_id"))
    return first.join(sources.select("source_id", "title"), "source_id").select("message_id", "index", "source_id", "title")


def flagged(rows: DataFrame, listing: DataFrame, key: str, flag: str) -> DataFrame:
    """Rows with whether a listing has their key."""
    there = listing.select(key, F.lit(True).alias(flag)).distinct()
    return rows.join(there, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def selection(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """The sources of each request (request_id, list_id, source_ids): those it names, or all of its list if it names none."""
    named = F.size(F.coalesce("source_ids", F.array().cast("array<long>"))) > 0
    own = requests.where(named).select("request_id", F.explode("source_ids").alias("source_id"))
    rest = requests.where(~named).select("request_id", "list_id").join(sources.select("list_id", "source_id"), "list_id").select("request_id", "source_id")
    return own.unionByName(rest)


def patched(base: DataFrame, patches: DataFrame, key: str, columns: list[str], required: list[str]) -> DataFrame:
    """Rows with the fields that a patch (key, JSON object) has, by null too; a blank required field refuses the patch."""
    p = patches.select(key, F.from_json("patch", "map<string,string>").alias("_p"))
    both = base.join(p, key, "left")
    has = lambda c: F.coalesce(F.map_contains_key("_p", F.lit(c)), F.lit(False))
    blank = F.lit(False)
    for c in required:
        blank = blank | (has(c) & (F.trim(F.coalesce(F.col("_p")[c], F.lit(""))) == ""))
    out = both.withColumn("refused", blank)
    for c in columns:
        out = out.withColumn(c, F.when(has(c) & ~F.col("refused"), F.trim(F.col("_p")[c])).otherwise(F.col(c)))
    return out.drop("_p")


def projected(events: DataFrame) -> DataFrame:
    """Events (message_id, pos, kind, content, index, name) as a replay buffer keeps them: other kinds go, absent fields
    get what a reader expects."""
    kept = events.where(F.col("kind").isin(BUFFERED))
    text = F.when(F.col("kind").isin("text", "error"), F.coalesce("content", F.lit("")))
    number = F.when(F.col("kind") == "citation", F.coalesce("index", F.lit(0)))
    tool = F.when(F.col("kind").isin("tool_start", "tool_end"), F.coalesce("name", F.lit("tool")))
    return kept.select("message_id", "pos", "kind", text.alias("content"), number.alias("index"), tool.alias("name"))


def flattened(system: Column, contents: Column, tools: Column) -> Column:
    """All that counts for a budget: the system text, messages and tool descriptions, a line each; absent ones go."""
    return F.concat_ws("\n", F.filter(F.concat(F.array(system), contents, tools), lambda x: x.isNotNull() & (x != "")))


def language_name(code: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(names[F.lower(F.trim(code))], F.lit(LANGUAGES["en"]))


def tool_errors(calls: DataFrame, known: list[str]) -> DataFrame:
    """Tool calls (name, query, section) with what is wrong with them, or null."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    wrong = F.when(~F.coalesce(F.col("name").isin(known), F.lit(False)), "unknown tool").when((F.col("name") == "find_passages") & blank("query"), "empty query").when((F.col("name") == "read_section") & blank("section"), "empty section")
    return calls.withColumn("error", wrong)


def tool_rounds(rounds: DataFrame, most: int = 3) -> DataFrame:
    """What recorded rounds of a turn (message_id, round, n_calls, answer) come to.

    Rounds with calls go on up to ``most``; then, or after a round without calls, there is an answer.  One that is empty
    is asked for once more without tools (``forced``), which is the recorded answer of the next round; if that is empty
    too the turn fails.
    """
    w = Window.partitionBy("message_id").orderBy("round")
    last = F.min(F.when((F.col("n_calls") == 0) | (F.col("round") > most), F.col("round"))).over(Window.partitionBy("message_id"))
    text = F.coalesce(F.trim("answer"), F.lit(""))
    seen = rounds.withColumn("_last", last).withColumn("_text", text).withColumn("_next", F.coalesce(F.lead(text).over(w), F.lit("")))
    end = seen.where("round = _last")
    forced = (F.col("_text") == "") | (F.col("round") > most)
    answer = F.when(F.col("_text") != "", F.col("_text")).otherwise(F.nullif("_next", F.lit("")))
    return end.select("message_id", (F.col("round") - 1).alias("tool_rounds"), forced.alias("forced"), answer.alias("answer"), F.when(answer.isNull(), "empty answer").alias("error"))


def history_rows(messages: DataFrame) -> DataFrame:
    """Messages as a reader sees them: blocks before the old text, else nothing; failed ones with what to say."""
    shown = F.coalesce(F.nullif(F.array_join("blocks", ""), F.lit("")), F.nullif("content", F.lit("")), F.lit(""))
    label = F.when(F.col("status") == "failed", F.coalesce(F.nullif("error", F.lit("")), F.lit("error"))).when(F.col("status") == "cancelled", "cancelled")
    return messages.select("message_id", shown.alias("shown"), label.alias("label"))


def pending_deletions(actions: DataFrame) -> DataFrame:
    """Ids whose deletion has begun and not ended (scope, id, action, at): the last action counts."""
    last = actions.groupBy("scope", "id").agg(F.max_by("action", F.struct("at", "action")).alias("action"))
    return last.where("action = 'start'").groupBy("scope").agg(F.array_sort(F.collect_list("id")).alias("pending"))


def newly_terminal(jobs: DataFrame, before: DataFrame) -> DataFrame:
    """Jobs that have ended and had not before (job_id)."""
    return jobs.where(F.col("status").isin(TERMINAL)).join(before.where(F.col("status").isin(TERMINAL)).select("job_id"), "job_id", "left_anti")


def cancelled(stages: DataFrame) -> DataFrame:
    """Jobs with stages (job_id, stage, at) and a time of cancelling: a stage that began before it is finished, none after
    it begins; what a cancelled job wrote is cleaned up before its row goes."""
    done = (F.col("cancel_at").isNull()) | (F.col("at") <= F.col("cancel_at"))
    out = stages.groupBy("job_id").agg(F.count_if(done).cast("int").alias("stages_run"), F.bool_or(~done).alias("cut"))
    return out.select("job_id", "stages_run", F.when(F.col("cut"), F.array(F.lit("cleanup"), F.lit("delete"))).otherwise(F.array().cast("array<string>")).alias("then"))
