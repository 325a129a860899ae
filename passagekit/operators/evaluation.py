"""Graded evaluation runs: answers parsed, scores by category and overall, failures, differences, report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_grade, signed_change

DIMENSIONS = ["context_relevance", "groundedness", "answer_relevance"]


def mean(column: str) -> Column:
    """One decimal, half to even; 0 where all scores are null."""
    return F.coalesce(F.bround(F.avg(column), 1), F.lit(0.0))


def aggregate(grades: DataFrame) -> DataFrame:
    """Means of each run by category, and overall over all single scores."""
    out = grades.groupBy("run_id", "category").agg(*(F.sum(d).alias(f"s_{d}") for d in DIMENSIONS), *(F.count(d).alias(f"n_{d}") for d in DIMENSIONS))
    rolled = out.groupingSets([["run_id", "category"], ["run_id"]], "run_id", "category").agg(
        *(F.coalesce(F.bround(F.sum(f"s_{d}") / F.sum(f"n_{d}"), 1), F.lit(0.0)).alias(d) for d in DIMENSIONS)
    )
    return rolled.select("run_id", F.coalesce("category", F.lit("overall")).alias("category"), *DIMENSIONS)


def failures(grades: DataFrame) -> DataFrame:
    """Null scores of each run by dimension."""
    return grades.groupBy("run_id").agg(*(F.count_if(F.col(d).isNull()).alias(d) for d in DIMENSIONS))


def difference(scores: DataFrame, run: int, before: int) -> DataFrame:
    """Changes of the categories that both runs have."""
    old = scores.where(F.col("run_id") == before).select("category", *(F.col(d).alias(f"_{d}") for d in DIMENSIONS))
    new = scores.where(F.col("run_id") == run)
    return new.join(old, "category").select("category", *(F.bround(F.col(d) - F.col(f"_{d}"), 1).alias(d) for d in DIMENSIONS))


def report(scores: DataFrame, run: int, before: int) -> DataFrame:
    """Rows of the report: categories by name, overall last, each score with its change."""
    old = scores.where(F.col("run_id") == before).select("category", *(F.col(d).alias(f"_{d}") for d in DIMENSIONS))
    new = scores.where(F.col("run_id") == run).join(old, "category", "left")
    cell = lambda d: F.trim(F.concat_ws(" ", F.col(d).cast("string"), signed_change(F.col(d), F.col(f"_{d}"))))
    return new.select("category", *(cell(d).alias(d) for d in DIMENSIONS)).orderBy((F.col("category") == "overall").cast("int"), "category")


def parsed_grades(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Scores from judges' answers; null with a reason where there is none from 1 to 5."""
    score = parse_grade(F.col(raw))
    return answers.withColumn("score", score).withColumn("reason", F.when(score.isNull(), "no score from 1 to 5"))


def question_counts(weights: DataFrame, floor: int = 3, surplus: int = 2) -> DataFrame:
    """Questions of each category: a floor for all, more for those marked."""
    return weights.select("category", (F.lit(floor) + F.when(F.col("marked"), F.lit(surplus)).otherwise(0)).alias("n"))
