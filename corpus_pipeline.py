"""A corpus from raw documents to token ids, in five stages.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; what it
returns is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents. Of every stage: an empty table gives an empty
one, repeated rows and equal ids are rows of their own unless said otherwise, and
columns that ``documents`` does not have stay as they are (not in the last stage).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import bpe, language_id, mixing, ngram_join, pii
from webloom.llm.tables import documents, packed, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known from the others. Null texts, texts without a letter and texts that fit no language go; all else stays as it is."""
    return language_id.in_known_language(docs, language_id.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group alike (five-word shingles, similarity of 0.8 or more): that of the smallest id, nulls last. Texts without words (null too) all stay; unlike documents all stay, whatever their ids."""
    return ngram_join.representatives(docs, n=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; personal data and terms that give it away are taken out of texts, and ``n_chars`` follows. Null texts stay null and keep their ``n_chars``."""
    clean = pii.sanitised(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that gives each source its share at any point: files, and rows within them. A null source is one of its own."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's doc_id, source, slot, place and token ids. Null texts are as empty ones.

    Reading files keeps no order, so the slot and place of the mix are worked out again
    and returned; sorting by them gives the order of the mix.
    """
    rows = packed(docs.select("doc_id", "source", "text"), _id=F.col("doc_id"), _source=F.col("source"))
    of = F.struct("_row.doc_id", "_row.source", "_mix.slot", "_mix.place").alias("_of")
    ids = bpe.encoded(mixing.placed(rows).select(of, F.col("_row.text").alias("text")), id_column="_of", ids=True)
    return ids.select("_of.*", *[c for c in ids.columns if c != "_of"])


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("tokens", tokens)]

#: Trained models and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
