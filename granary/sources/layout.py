"""How a table's rows lie in its files.

sequential and btree: sorted by the key over all files, so ranges and lookups skip files and row groups
by their minima and maxima. hash: dealt to folders by a hash of the key, so a lookup reads one folder; the
number of folders is a power of two that grows with the rows, so that twice as many split each folder in
two and a folder never holds much more than ``ROWS_PER_FILE``. A key with very many rows is split over
several files of its folder, or of the sorted order. rtree: ordered along a Z curve over the table's points, so that both axes have narrow ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from granary.operators.spatial import z_value

BUCKET = "__bucket"
#: The least number of folders of a hash layout.
BUCKETS = 32
#: Rows of a file, about; also what a layout pass aims at when it picks the number of files.
ROWS_PER_FILE = 4_000_000


def buckets_for(rows: int) -> int:
    """The folders of a hash layout of so many rows."""
    return max(BUCKETS, 1 << max(0, _files(rows) - 1).bit_length())


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _files(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_FILE))


def arranged(df: DataFrame, kind: str, key: str, spatial: tuple[str, str] | None, rows: int) -> DataFrame:
    """df in the order of its layout; rows: how many it has, about."""
    if kind == "HASH":
        n = buckets_for(rows)
        dealt = df.withColumn(BUCKET, bucket_of(F.col(key), n))
        # Adaptive execution merges small folders into one task and splits a very large one over several.
        dealt = dealt.repartition(min(n, _files(rows) * 4), BUCKET) if rows < ROWS_PER_FILE else dealt.hint("rebalance", BUCKET)
        return dealt.sortWithinPartitions(BUCKET, key)
    if spatial:
        x, y = (F.col(c).cast("double") for c in spatial)
        found = df.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
        bounds = tuple(float(v) if v is not None else 0.0 for v in found)
        by = "__z"
        out = df.withColumn(by, z_value(F.col(spatial[0]), F.col(spatial[1]), bounds))
        return out.repartitionByRange(_files(rows), by).sortWithinPartitions(by).drop(by)
    # Rows of one key may be split by what else they hold.
    by = [key] if rows < ROWS_PER_FILE else [key, F.xxhash64(*df.columns)]
    return df.repartitionByRange(_files(rows), *by).sortWithinPartitions(key)


def writer(df: DataFrame) -> DataFrameWriter:
    return df.write.partitionBy(BUCKET) if BUCKET in df.columns else df.write
