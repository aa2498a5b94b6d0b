"""Exact deduplication by progressive refinement, with DataFrame functions only.

Rows are grouped by length, then by the hash of a prefix, then by the SHA-256 of the whole text.
Each step's surviving groups (two rows or more) go into a split-block Bloom filter that is as large as
they need, up to a bound; the next step goes on only where the filter says that a row may belong to one.
Filters err on one side only, so they save work and never change the result; whole texts are never
shuffled to find groups, only keys of a few dozen bytes.

Defined results: a null text counts as empty; of equal texts the largest doc_id stays (null ids
only if the group has no other); rows that repeat both id and text count in group_size, are all
marked as kept by ``annotate``, and come out once from ``deduplicate``; an empty table gives an
empty result. Extra columns pass through ``deduplicate``; names that begin with ``__`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import bloom
from granary.llm.common import materialise, text_or_empty

PREFIX_CHARS = 64


def _groups(rows: DataFrame, *keys: str) -> DataFrame:
    """The hashes of the key tuples that two rows or more share."""
    return (
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.xxhash64(*keys).alias("__key"))
    )


def _filter(groups: DataFrame) -> tuple[DataFrame, int]:
    """The filter of some groups' hashes, and its number of blocks."""
    keys = materialise(groups, "groups", narrow=True)
    n_blocks = bloom.blocks_for(keys.count())
    return bloom.build(keys, "__key", n_blocks), n_blocks


def _refined(docs: DataFrame, text_col: str, digest_all: bool) -> DataFrame:
    """docs with __sha: null where the refinement shows that a text has no copy (unless digest_all); __hit
    tells these from the others. Two reads of the texts: one for lengths and prefixes, which are written
    and then refined, one for the digests of what survives."""
    text = text_or_empty(text_col)
    keyed = docs.withColumn("__len", F.octet_length(text).cast("bigint")).withColumn("__pre", F.xxhash64(F.substring(text, 1, PREFIX_CHARS)))
    keys = materialise(keyed.select("__len", "__pre"), "lengths")
    lengths, n_blocks = _filter(_groups(keys, "__len"))
    same_length = bloom.probe(keys.withColumn("__key", F.xxhash64("__len")), "__key", lengths, "__hit", n_blocks)
    prefixes, n_blocks = _filter(_groups(same_length.where("__hit"), "__len", "__pre"))
    same_prefix = bloom.probe(keyed.withColumn("__key", F.xxhash64("__len", "__pre")), "__key", prefixes, "__hit", n_blocks)
    sha = F.sha2(text, 256)
    return same_prefix.withColumn("__sha", sha if digest_all else F.when(F.col("__hit"), sha)).drop("__key", "__len", "__pre")


def _kept(rows: DataFrame, id_col: str) -> DataFrame:
    return (
        rows.where("__hit")
        .groupBy("__sha")
        .agg(F.max(id_col).alias("__keep"), F.count(F.lit(1)).alias("__size"))
    )


def annotate(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", digest_all: bool = False) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256 (null for texts that the
    refinement shows to be unique, unless digest_all)."""
    rows = materialise(_refined(docs, text_col, digest_all).select(id_col, "__hit", "__sha"), "digests")
    # A written table, not the aggregate itself: the join then deals out both sides anew, and
    # Spark can split a large group's rows over several tasks.
    groups = materialise(_kept(rows, id_col).where("__size > 1"), "copies", narrow=True)
    return rows.join(groups, "__sha", "left").select(
        id_col,
        F.when(F.col("__size").isNull(), F.col(id_col)).otherwise(F.col("__keep")).alias("keep_id"),
        F.coalesce("__size", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("__size").isNull() | F.col("__keep").eqNullSafe(F.col(id_col))).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows that the filters rule out pass straight through. The others meet their group's keeper by
    hash and id together, so that a large group spreads over the partitions.
    """
    rows = _refined(docs, text_col, False)
    keepers = _kept(rows.select(id_col, "__hit", "__sha"), id_col).select(
        F.col("__sha").alias("__group"), "__keep"
    )
    stay = (
        rows.where("__hit")
        .join(keepers, (F.col("__sha") == F.col("__group")) & F.col(id_col).eqNullSafe(F.col("__keep")))
        .dropDuplicates(["__sha", id_col])
    )
    return rows.where(~F.col("__hit")).select(*docs.columns).unionByName(stay.select(*docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return annotate(docs, digest_all=True)


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
