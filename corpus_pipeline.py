"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage takes any documents: null, empty and very long texts, nulls in other columns, repeated rows, empty
tables and extra columns, which all stages but the last keep. ``run`` removes what a stage wrote for
itself, and its input, once its output is written; if a stage fails, all that the run has written goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import exact_dedup, langid, near_dedup, packing, pii
from granary.llm.common import materialise, release, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go, those with a null text or without a letter among them; a null
    lang becomes the predicted one. Without a labelled document nothing is learnt, and all go."""
    found = langid.classify(docs, langid.fit(docs), names=("__lang", "__score", "__accepted")).where("__accepted")
    return found.withColumn("lang", F.coalesce("lang", "__lang")).select(*docs.columns)


def exact_dedup_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, null and empty ones being equal, the row with the largest doc_id stays: a null id only if
    there is no other, and of rows that repeat id and text one."""
    return exact_dedup.deduplicate(docs)


def near_dedup_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8), the least doc_id stays. Texts without a
    word and rows without an id stay."""
    return near_dedup.deduplicate(docs)


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows. A null text stays null, with null n_chars."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its bin, place and offset. Sizes are tokens. Bins keep apart documents of
    one source, and those whose texts redaction has made equal: near copies are gone by now."""
    return packing.by_tokens(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup_),
    ("near_dedup", near_dedup_),
    ("pii", remove_pii),
    ("packing", pack),
]

#: A trained model and similarity search are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    try:
        for name, stage in STAGES:
            docs = materialise(stage(spark, docs, sf_dir), name)
            release(spark, before, but_last=True)
    except BaseException:
        release(spark, before)
        raise
    return docs
