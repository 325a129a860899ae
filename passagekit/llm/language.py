"""Language identification by hyperdimensional profiles.

Every letter has a random +-1 vector.  A trigram's vector binds (multiplies) its letters' vectors, permuted (rotated) by
their place; a document's vector bundles (adds) its trigrams, a language's prototype bundles its training documents.
The language whose prototype has the largest cosine with the document wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import documents, map_batches, slices
from .textkit import mix

DIMENSIONS = 1024
GRAM = 3
TRAIN_ROWS = 20_000  # training documents, about: the documented bound of the sample
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: its lower-case letter, or 0 if it is none."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """+-1 vectors that depend on the code point alone."""
    grid = codes.astype(np.uint64)[:, None] * np.uint64(DIMENSIONS) + np.arange(DIMENSIONS, dtype=np.uint64)
    return np.where(mix(grid + np.uint64(0x51ED270B)) >> np.uint64(63), 1, -1).astype(np.int8)


class GramVectors:
    """Vectors of trigrams, made on first sight and kept; at most ``limit`` of them."""

    def __init__(self, limit: int = 40_000):
        self.limit, self.slot, self.rows = limit, {}, np.zeros((0, DIMENSIONS), np.int8)

    def of(self, grams: np.ndarray) -> np.ndarray:
        new = [g for g in grams.tolist() if g not in self.slot]
        if len(self.slot) + len(new) > self.limit:
            self.slot, self.rows, new = {}, self.rows[:0], grams.tolist()
        if new:
            keys = np.array(new, np.uint64)
            made = np.ones((len(keys), DIMENSIONS), np.int8)
            for i in range(GRAM):
                codes = (keys >> np.uint64(21 * (GRAM - 1 - i))) & np.uint64(0x1FFFFF)
                distinct, back = np.unique(codes, return_inverse=True)
                made *= np.roll(letter_vectors(distinct), GRAM - 1 - i, axis=1)[back]
            self.slot.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, made])
        return self.rows[[self.slot[g] for g in grams.tolist()]]


_grams = GramVectors()


def document_vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bundle of each text's trigrams (words are padded by one space), and its number of letters."""
    code = np.frombuffer("".join(t + "\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    # one space before, between and behind words; texts are set apart by their row
    size = np.array([len(t) + 1 for t in texts])
    row = np.repeat(np.arange(len(texts)), size)
    letter = _letters()[code]
    full = letter > 0
    keep = full.copy()
    keep[1:] |= full[:-1]  # the break right behind a letter stands for the space between two words
    letter, row = letter[keep], row[keep]
    letters = np.bincount(row, letter > 0, len(texts)).astype(np.int64)
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    starts = np.flatnonzero(first)
    letter, row = np.insert(letter, starts, 0), np.insert(row, starts, row[starts])
    out = np.zeros((len(texts), DIMENSIONS))
    if len(row) < GRAM:
        return out, letters
    letter = letter.astype(np.uint64)
    gram, one = np.zeros(len(row) - GRAM + 1, np.uint64), row[GRAM - 1 :] == row[: len(row) - GRAM + 1]
    for i in range(GRAM):
        gram = gram << np.uint64(21) | letter[i : i + len(gram)]
    distinct, back = np.unique(gram[one], return_inverse=True)
    pair, count = np.unique(row[: len(gram)][one] * np.int64(len(distinct)) + back, return_counts=True)
    doc, which = pair // max(1, len(distinct)), pair % max(1, len(distinct))
    edge = np.searchsorted(doc, np.arange(len(texts) + 1))
    count = count.astype(np.float32)
    for lo in range(0, len(distinct), 8192):  # bounded blocks of trigram vectors
        vectors = _grams.of(distinct[lo : lo + 8192]).astype(np.float32)
        for i in range(len(texts)):
            a, b = edge[i] + np.searchsorted(which[edge[i] : edge[i + 1]], [lo, lo + len(vectors)])
            if b > a and count[a:b].sum() < 1 << 24:  # exact in single precision
                out[i] += count[a:b] @ vectors[which[a:b] - lo]
            elif b > a:
                out[i] += count[a:b].astype(np.float64) @ vectors[which[a:b] - lo]
    return out, letters


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def train(df: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Prototypes of (doc_id, text, lang): unit document vectors added by language.

    At most about ``rows`` documents are read as training texts, chosen by a hash of doc_id with equal shares for the
    languages.  Bundling is a sum, made in the tasks and then by Spark; the driver gets one vector (8 kB) a language.
    """
    labelled = df.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    size = labelled.groupBy("lang").agg(F.count("*").alias("size"))
    share = size.crossJoin(size.agg(F.count("*").alias("langs"))).select("lang", (F.lit(rows) / F.col("langs") / F.col("size")).alias("share"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.join(share, "lang").where(draw < F.col("share"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in slices(batch):
            vectors, _ = document_vectors(part.column(0).to_pylist())
            for lang, v in zip(part.column(1).to_pylist(), _unit(vectors), strict=True):
                sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        langs = list(sums)
        place = np.tile(np.arange(DIMENSIONS), len(langs))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x in langs for _ in range(DIMENSIONS)]), pa.array(place, pa.int32()), pa.array(np.concatenate([sums[x] for x in langs]))],
            ["lang", "place", "value"],
        )

    # sums of doubles in any order: rounded, so that prototypes are the same on each run
    profile = map_batches(chosen.select("text", "lang"), run, "lang string, place int, value double").groupBy("lang", "place").agg(F.round(F.sum("value"), 4).alias("value"))
    found = profile.toArrow()
    langs = sorted(set(found["lang"].to_pylist()))
    out = np.zeros((len(langs), DIMENSIONS))
    index = {x: i for i, x in enumerate(langs)}
    out[[index[x] for x in found["lang"].to_pylist()], found["place"].to_numpy()] = found["value"].to_numpy()
    return langs, _unit(out)


def predict(df: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """df, further columns included, with lang_pred, score, the cosine of ``text`` with the winning prototype, at
    least 0, and has_letter; columns of these names are replaced.

    ``und`` with score 0: text null, empty or without a letter, or nothing learned.  Ties go to the first language by
    name.  Whole texts count, of any length.  Repeated rows give repeated results; an empty table gives an empty one.
    """
    df = df.drop("lang_pred", "score", "has_letter")
    place = df.columns.index("text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            vectors, letters = document_vectors(part.column(place).fill_null("").to_pylist())
            some = (letters > 0) & bool(langs)
            cosine = _unit(vectors) @ prototypes.T if langs else np.zeros((len(vectors), 1))
            best = cosine.argmax(axis=1)
            pred = [langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), some.tolist(), strict=True)]
            score = np.where(some, np.clip(cosine.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred), pa.array(np.round(score, 6)), pa.array(letters > 0)], [*part.schema.names, "lang_pred", "score", "has_letter"])

    return map_batches(df, run, StructType([*df.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("has_letter", BooleanType())]))


def held_out(folds: int, ident: str = "doc_id") -> Column:
    return F.crc32(F.col(ident).cast("string").cast("binary")) % folds == 0


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    langs, prototypes = train(docs.where(~held_out(5)))
    out = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), langs, prototypes)
    return out.select("doc_id", held_out(5).alias("held_out"), "lang_pred", "score")
