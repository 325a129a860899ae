"""Tokens of Han text: characters and bigrams for the index, bigrams for queries, syllables for homophones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import HAN


def collapse_spaces(text: Column) -> Column:
    """Drop white space between two Han characters."""
    return F.regexp_replace(text, rf"(?<=[{HAN}])\s+(?=[{HAN}])", "")


def runs(text: Column) -> Column:
    """Alternating runs of Han and other characters."""
    return F.regexp_extract_all(text, F.lit(rf"[{HAN}]+|[^{HAN}]+"), F.lit(0))


def _characters(run: Column) -> Column:
    return F.filter(F.split(run, ""), lambda x: x != "")


def _bigrams(run: Column) -> Column:
    n = F.length(run)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2))))


def _split(run: Column) -> Column:
    return F.filter(F.split(F.trim(run), r"\s+"), lambda x: x != "")


def index_tokens(text: Column) -> Column:
    """Han runs as characters and then bigrams; other runs by white space."""
    han = lambda r: r.rlike(f"^[{HAN}]")
    return F.flatten(F.transform(runs(collapse_spaces(text)), lambda r: F.when(han(r), F.concat(_characters(r), _bigrams(r))).otherwise(_split(r))))


def query_tokens(text: Column) -> Column:
    """Han runs as bigrams, a single character as itself; white space separates words."""
    han = lambda r: r.rlike(f"^[{HAN}]")
    own = lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(_bigrams(r))
    return F.flatten(F.transform(runs(text), lambda r: F.when(han(r), own(r)).otherwise(_split(r))))


def syllables_of(run: Column, syllables: Column, phrases: Column | None = None, longest: int = 4) -> Column:
    """The syllables of a Han run: of the longest phrase that begins where the last one ended, else of the character.

    ``phrases`` maps phrases of two to ``longest`` characters to a syllable for each; a character without one stands for
    itself.
    """
    one = lambda c: F.coalesce(syllables[c], c)
    if phrases is None:
        return F.transform(_characters(run), one)
    at = lambda i: F.coalesce(*(phrases[F.substring(run, i, F.lit(n))] for n in range(longest, 1, -1)), F.array(one(F.substring(run, i, F.lit(1)))))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("said"))

    def read(state: Column, i: Column) -> Column:
        more = F.struct((i + F.size(at(i))).alias("next"), F.concat(state["said"], at(i)).alias("said"))
        return F.when(i < state["next"], state).otherwise(more)

    return F.aggregate(F.sequence(F.lit(1), F.length(run)), start, read, lambda state: state["said"])


def syllable_tokens(text: Column, syllables: Column, phrases: Column | None = None, longest: int = 4) -> Column:
    """Bigrams of syllables of each Han run, by maps from characters and from phrases; single characters give none."""
    only = F.filter(runs(collapse_spaces(text)), lambda r: r.rlike(f"^[{HAN}]"))
    pairs = lambda s: F.when(F.size(s) < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda i: F.concat(F.element_at(s, i), F.element_at(s, i + 1)))
    )
    return F.flatten(F.transform(only, lambda r: pairs(syllables_of(r, syllables, phrases, longest))))
