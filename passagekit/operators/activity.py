"""Tool calls, previews, models and runs: small relational steps around conversations and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import ACTIVE
from .evidence import joined

#: Tools whose results are not sent again with the history.
NOT_REPLAYED = ["find_passages", "retrieve", "read_section"]


def assemble_calls(fragments: DataFrame, schema: str) -> DataFrame:
    """(message_id, call, pos, part) -> each call's arguments, joined in order and parsed; those that do not parse go."""
    whole = fragments.groupBy("message_id", "call").agg(joined("part", "pos", "").alias("raw"))
    args = F.from_json("raw", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    parsed = whole.withColumn("args", args).where("args IS NOT NULL AND args._bad IS NULL")
    return parsed.select("message_id", "call", "args.*").drop("_bad")


def replayable(messages: DataFrame, blocks: str = "tool_blocks") -> DataFrame:
    """Messages with the tool blocks that go to the model again."""
    return messages.withColumn(blocks, F.filter(blocks, lambda b: b["name"].isNotNull() & ~b["name"].isin(NOT_REPLAYED)))


def expand_parts(ids: DataFrame, listing: DataFrame) -> DataFrame:
    """(asked) -> the part ids of each: a bare id has all its parts (base, part), one with a part has itself."""
    from ..functions.text import split_video_id

    base, part = split_video_id(F.col("asked"))
    split = ids.select("asked", base.alias("base"), part.alias("_part"))
    own = split.where("_part IS NOT NULL").select("asked", F.col("asked").alias("part_id"))
    all_ = split.where("_part IS NULL").join(listing, "base").select("asked", F.concat("base", F.lit("_p"), F.col("part").cast("string")).alias("part_id"))
    return own.unionByName(all_)


def preview(statuses: DataFrame, by: str) -> DataFrame:
    """What a listing holds: how many are new, how many need a login, and what to say of it."""
    n = statuses.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "new").alias("n_new"), F.count_if(F.col("status") == "needs_auth").alias("n_auth"))
    say = F.when((F.col("n") == 1) & (F.col("n_new") == 0), "single").when(F.col("n_auth") > 0, "needs_auth").when(F.col("n_new") == 0, "none_new").otherwise("some")
    return n.withColumn("state", say)


def model_states(models: DataFrame, installed: DataFrame, jobs: DataFrame) -> DataFrame:
    """Models (model, required) with whether they are installed, loading or missing."""
    have = installed.select("model", F.lit(True).alias("_have")).distinct()
    busy = jobs.where(F.col("status").isin(ACTIVE)).select("model", F.lit(True).alias("_busy")).distinct()
    state = F.when(F.col("_have"), "installed").when(F.col("_busy"), "downloading").when(F.col("required"), "missing").otherwise("optional")
    return models.join(have, "model", "left").join(busy, "model", "left").select(*models.columns, state.alias("state"))


def health(checks: DataFrame, by: str) -> DataFrame:
    """Error if a blocking check failed, degraded if any did, else ok."""
    failed = ~F.col("ok")
    state = F.when(F.bool_or(failed & F.col("blocking")), "error").when(F.bool_or(failed), "degraded").otherwise("ok")
    return checks.groupBy(by).agg(state.alias("state"))


def runs_by_grading(runs: DataFrame, grades: DataFrame) -> DataFrame:
    """Runs with whether any of their cases has been graded."""
    graded = grades.select("run_id").distinct()
    yes = runs.join(graded, "run_id", "left_semi").withColumn("graded", F.lit(True))
    return yes.unionByName(runs.join(graded, "run_id", "left_anti").withColumn("graded", F.lit(False)))


def report_cases(cases: DataFrame, grades: DataFrame, run: int, before: int, score: str) -> DataFrame:
    """Each case of a run with its score and the change from another run; null where either is missing."""
    of = lambda r, name: grades.where(F.col("run_id") == r).select("case_id", F.col(score).alias(name))
    out = of(run, "score").join(cases, "case_id", "left").join(of(before, "_before"), "case_id", "left")
    return out.select("case_id", F.coalesce("category", F.lit("unknown")).alias("category"), "score", (F.col("score") - F.col("_before")).alias("change"))


def cited_calls(calls: DataFrame, cited: DataFrame) -> DataFrame:
    """Rows of tool results with whether their number was cited in the answer."""
    c = cited.select("query_id", "index", F.lit(True).alias("_c")).distinct()
    return calls.join(c, ["query_id", "index"], "left").withColumn("cited", F.coalesce("_c", F.lit(False))).drop("_c")
