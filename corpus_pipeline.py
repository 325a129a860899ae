"""From documents to packed training sequences: five stages over all rows, each written and reread.

Each stage takes (spark, docs, sf_dir), docs having the columns of ``documents``, and all but the last return these; further
columns go, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.llm.common import Scratch, clean, documents
from passagekit.llm.jaccard import jaccard_components
from passagekit.llm.language import held_out, predict, train
from passagekit.llm.packing import pack_documents
from passagekit.llm.pii import masked
from passagekit.llm.substrings import without_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter, whatever was learned of languages: only texts without any letter go.

    A null lang is filled with the predicted language; where nothing was learned it stays null.  Repeated rows stay.
    """
    langs, prototypes = train(docs.where(~held_out(5)))
    known = predict(docs.select(*COLUMNS), langs, prototypes).where("has_letter")
    return known.withColumn("lang", F.coalesce("lang", F.when(F.lit(bool(langs)), F.col("lang_pred")))).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingle sets the one with the smallest id.

    Rows without an id cannot stand for a group: all stay, but for repeats of the same text.  Of repeated rows of one
    id and text one stays; of rows of one id with several texts, each; texts without words are linked with nothing.
    """
    first = jaccard_components(docs.select(*clean())).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").select(*COLUMNS).union(docs.where("doc_id IS NULL").select(*COLUMNS))
    return kept.dropDuplicates(["doc_id", "text"])


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of smaller id has already; texts left empty go.

    Null, empty and short texts have no passages and stay; repeats within a document, or between rows of one id, stay.
    """
    return _counted(without_repeats(docs.select(*COLUMNS)))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked; null texts stay null, repeated rows give repeated results."""
    return _counted(masked(docs.select(*COLUMNS)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a null or empty text is one piece of the end id, repeated rows are packed each by itself."""
    import public_tokenizers

    return pack_documents(docs.select(*clean()), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each_group),
    ("substring_dedup", unrepeated),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: Hashes of tokenizer ids and the network's spans are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
