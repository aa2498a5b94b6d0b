"""A split-block Bloom filter made of DataFrame functions only.

A filter is a table of at most n_blocks rows ``(block int, w0..w7 bigint)``; each key sets one bit
in each of the eight words of its block. ``blocks_for`` gives it as many blocks as its keys need, up to
``MAX_BLOCKS``, so its size has a fixed bound (n_blocks * 72 bytes, 19 MB at most) and it can be
broadcast. With more keys than 64 for each of these blocks (16.8 million) it is overfull and passes more
false positives, which every caller removes by an exact step: a shuffle join, whose work is then that of
the join alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
MAX_BLOCKS = 1 << 18
#: Keys of a block of 512 bits.
KEYS_PER_BLOCK = 32


def blocks_for(n_keys: int) -> int:
    """The number of blocks that so many keys need, a power of two."""
    return min(MAX_BLOCKS, 1 << max(6, (n_keys // KEYS_PER_BLOCK).bit_length()))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0x5EED)), F.lit(n_blocks)).cast("int")


def _bit(key: Column, word: int) -> Column:
    at = F.shiftrightunsigned(key, 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), at)


def build(keys: DataFrame, key: str, n_blocks: int = 1 << 14) -> DataFrame:
    """The filter of the bigint hashes in column key; null keys are left out."""
    if not 0 < n_blocks <= MAX_BLOCKS:
        raise ValueError(f"n_blocks must be from 1 to {MAX_BLOCKS}: a filter is broadcast")
    k = F.col(key)
    return (
        keys.where(k.isNotNull())
        .groupBy(_block(k, n_blocks).alias("__bf_block"))
        .agg(*[F.bit_or(_bit(k, w)).alias(f"__bf_w{w}") for w in range(WORDS)])
    )


def probe(df: DataFrame, key: str, filter_: DataFrame, hit: str, n_blocks: int = 1 << 14) -> DataFrame:
    """df with a boolean column ``hit``: whether the filter may hold the hash in column key."""
    k = F.col(key)
    joined = df.withColumn("__bf_block", _block(k, n_blocks)).join(F.broadcast(filter_), "__bf_block", "left")
    passes = F.lit(True)
    for w in range(WORDS):
        passes = passes & (F.col(f"__bf_w{w}").bitwiseAND(_bit(k, w)) != 0)
    return joined.withColumn(hit, F.coalesce(passes & k.isNotNull(), F.lit(False))).drop(
        "__bf_block", *[f"__bf_w{w}" for w in range(WORDS)]
    )
