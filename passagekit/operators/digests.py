"""Digests and evaluation sets: section views, batches, rolling folds over a model's answers, facts, questions, judgments.

A model is any function from prompts to answers (``operators.models``); a fold that feeds an answer into the next prompt
goes through one recording in a task.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_mmss, parse_grade
from .evidence import joined
from .models import answered

Call = Callable[[list[str]], list[str]]
RESERVE = 500
#: Judgments of a case.
JUDGMENTS = ["context_relevance", "groundedness", "answer_relevance"]


def batch_budget(window: int, answer: int) -> int:
    """Tokens for one batch: the window less room for two answers and a reserve."""
    return window - 2 * answer - RESERVE


def over_batch(tokens: Column, budget: int) -> Column:
    """What to say of a section that no batch can hold, else null."""
    return F.when(tokens > budget, F.concat(F.lit("section of "), tokens.cast("string"), F.lit(f" tokens exceeds {budget}")))


def batch_header(title: Column, section: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("=== Source: "), title, F.lit(" · Section "), section.cast("string"), F.lit(" ("), format_mmss(start), F.lit("-"), format_mmss(end), F.lit(") ==="))


def section_views(selected: DataFrame, sections: DataFrame, texts: DataFrame) -> DataFrame:
    """Sections of the selected sources (source_id, ord) with their text, in the order of the selection and then theirs;
    ``error`` tells of a source without sections and of a section without text."""
    view = selected.join(sections, "source_id", "left").join(texts, ["source_id", "section_seq"], "left")
    error = F.when(F.col("section_seq").isNull(), "no sections").when(F.col("text").isNull(), "no text")
    return view.withColumn("error", error)


def zipped(sections: DataFrame, digests: DataFrame) -> DataFrame:
    """Sections with their digests (source_id, ord, digest) by place; sources whose numbers of both differ get none, and an error."""
    n = sections.groupBy("source_id").agg(F.count("*").alias("n")).join(digests.groupBy("source_id").agg(F.count("*").alias("m")), "source_id", "full")
    known = n.select("source_id", (F.coalesce("n", F.lit(0)) == F.coalesce("m", F.lit(0))).alias("equal"))
    own = digests.select("source_id", F.col("ord").alias("section_seq"), "digest")
    out = sections.join(known, "source_id").join(own, ["source_id", "section_seq"], "left")
    return out.select("source_id", "section_seq", F.when(F.col("equal"), F.col("digest")).alias("digest"), F.when(~F.col("equal"), "lengths differ").alias("error"))


def _fold(rows: DataFrame, order: str, step: Callable[[list[str], str], str], call: Call, schema: str, whole: bool) -> DataFrame:
    """Each source's texts in order, every prompt made of the answers before it.  A step that fails has its error, and the
    next one goes on without it.  A group is one recording; the fold is one job for all of them."""

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by(order)
        said: list[str] = []
        out = []
        for nth, text in zip(t[order].to_pylist(), t["text"].to_pylist(), strict=True):
            try:
                answer, error = call([step(said, text)])[0], None
                said.append(answer)
            except Exception as e:  # noqa: BLE001 - whatever a model raises becomes the row's error
                answer, error = None, f"{type(e).__name__}: {e}"
            out.append((nth, answer, error))
        if whole:
            out = [(out[-1][0], said[-1] if said else None, next((e for _, _, e in out if e), None))]
        own = t["source_id"][0].as_py()
        names = [c.split()[0] for c in schema.split(", ")]
        return pa.table([pa.array([own] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())], names=names)

    return rows.select("source_id", F.col(order).cast("int").alias(order), F.coalesce("text", F.lit("")).alias("text")).groupBy("source_id").applyInArrow(run, schema)


def digest_sections(sections: DataFrame, call: Call) -> DataFrame:
    """(source_id, section_seq, text) -> the digest of each section.  The first is digested by itself, every later one
    with the digests before it, each as [Sn]."""

    def step(said: list[str], text: str) -> str:
        return "\n".join([*(f"[S{i}] {x}" for i, x in enumerate(said, 1)), text])

    return _fold(sections, "section_seq", step, call, "source_id long, section_seq int, digest string, error string", False)


def refine(batches: DataFrame, call: Call) -> DataFrame:
    """(source_id, batch, text) -> one draft a source: the first batch makes it, each later one is read with the draft so far."""

    def step(said: list[str], text: str) -> str:
        return f"Draft: {said[-1]}\n{text}" if said else text

    return _fold(batches, "batch", step, call, "source_id long, batch int, draft string, error string", True)


def capped_keywords(words: Column, most: int = 8) -> Column:
    """Trimmed keywords without blanks, the first eight."""
    return F.slice(F.filter(F.transform(words, lambda x: F.trim(x)), lambda x: x != ""), 1, most)


# --- evaluation sets --------------------------------------------------------------------------------------------------


def extracted_facts(sources: DataFrame, call: Call) -> DataFrame:
    """(source_id, text) -> facts, one a line of the answer, or the error of a source that failed twice."""
    out = answered(sources.select("source_id", F.col("text").alias("prompt")), "prompt", call, attempts=2)
    lines = F.filter(F.transform(F.split("answer", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return out.select("source_id", lines.alias("facts"), "error")


def fact_blocks(facts: DataFrame) -> DataFrame:
    """Each source's facts as a numbered list under its title."""
    lines = F.array_join(F.transform("facts", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return facts.where("size(facts) > 0").select("source_id", F.concat(F.lit("# "), "title", F.lit("\n"), lines).alias("block"))


def questions_of(counts: dict[str, int], blocks: DataFrame, call: Call, known: list[str]) -> DataFrame:
    """So many questions of each known category over each block: the answer's first n lines; other categories go."""
    some = [F.struct(F.lit(c).alias("category"), F.lit(n).alias("n")) for c, n in counts.items() if c in known]
    asked = blocks.select("*", F.inline(F.array(*some)))
    prompt = F.concat_ws("\n", F.concat(F.lit("category "), "category", F.lit(", "), F.col("n").cast("string"), F.lit(" questions")), F.col("block"))
    out = answered(asked.select("category", "n", "source_id", prompt.alias("prompt")), "prompt", call)
    lines = F.slice(F.filter(F.split("answer", "\n"), lambda x: F.trim(x) != ""), 1, F.col("n"))
    return out.select("category", "source_id", F.posexplode(lines).alias("pos", "question"))


def run_cases(cases: DataFrame, call: Call) -> DataFrame:
    """Answers to the locked cases (case_id, question, locked); a case that fails has its error, and no other fails with it."""
    return answered(cases.where("locked").select("case_id", F.col("question").alias("prompt")), "prompt", call, attempts=1).select("case_id", "answer", "error")


def mapped_response(responses: DataFrame) -> DataFrame:
    """Responses (case_id, answer, tool_calls) -> the context that was cited: the sections of calls that have some, else
    the call itself; calls and sections that were not cited go."""
    one = responses.select("case_id", "answer", F.posexplode_outer("tool_calls").alias("call", "c"))
    parts = F.when(F.size("c.sections") > 0, F.filter("c.sections", lambda s: s["cited"])).otherwise(F.when(F.col("c.cited"), F.array(F.struct(F.col("c.text").alias("text"), F.col("c.cited").alias("cited")))))
    rows = one.select("case_id", "answer", "call", F.posexplode_outer(parts).alias("pos", "part"))
    text = F.filter(F.array_sort(F.collect_list(F.struct("call", "pos", F.col("part.text").alias("text")))), lambda x: x["text"].isNotNull())
    return rows.groupBy("case_id", "answer").agg(F.array_join(F.transform(text, lambda x: x["text"]), "\n").alias("context"))


def judged(cases: DataFrame, call: Call) -> DataFrame:
    """(case_id, category, question, answer, context) -> a score by judgment.

    Cases of ``causal_absent`` have one judgment, which fills all; those of ``coverage`` are judged by coverage instead of
    relevance; an empty answer or context is named as such.  An answer without a score from 1 to 5 is asked for once more.
    """
    said = lambda c, empty: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(empty))
    one = F.col("category") == "causal_absent"
    kinds = F.when(one, F.array(F.lit("absence"))).otherwise(F.array(*(F.when((F.col("category") == "coverage") & F.lit(j == "answer_relevance"), "coverage").otherwise(j) for j in JUDGMENTS)))
    rows = cases.select("case_id", F.explode(kinds).alias("kind"), F.concat_ws("\n", "question", said("answer", "(no answer)"), said("context", "(no context)")).alias("_body"))
    rows = rows.withColumn("prompt", F.concat_ws("\n", "kind", "_body"))
    first = answered(rows, "prompt", call).withColumnRenamed("answer", "_a").drop("error")
    again = answered(first.withColumn("_again", F.when(parse_grade(F.col("_a")).isNull(), F.concat(F.col("prompt"), F.lit("\nagain")))), "_again", call)
    score = again.withColumn("score", F.coalesce(parse_grade(F.col("_a")), parse_grade(F.col("answer"))))
    of = lambda *names: F.max(F.when(F.col("kind").isin("absence", *names), F.col("score")))
    return score.groupBy("case_id").agg(of("context_relevance").alias("context_relevance"), of("groundedness").alias("groundedness"), of("answer_relevance", "coverage").alias("answer_relevance"))
