"""Conflict-constrained best-fit packing of documents into sequences of fixed capacity.

A bin holds at most one document of each source and one of each cluster of duplicates. Documents are
dealt to shards of about ``SHARD_ROWS`` rows by a hash of id and cluster, so a frequent source or a
large cluster spreads over all shards. A shard packs its pieces by falling size: its bins are ordered
by what they have left and carry bitmaps of the sources and clusters they hold; the search starts at
the tightest bin that is large enough and goes on to the next larger ones until one is compatible;
if none is, it opens a new bin. Only ids, sizes and hashes are shuffled, not texts.

A document of more tokens than a bin has is cut into full pieces, each a bin of its own, and a rest.
Every piece is placed; every document ends with one end token, so an empty one has size 1. ``by_tokens``
takes a document's size from byte-level BPE.

Rows that agree in id and cluster all fall to one shard; a shard that comes to twice its rows is packed
and begun anew, so memory and the search for bins stay bounded however often a row is repeated.

Defined results: a null text is empty; null sources and clusters conflict with nothing; rows that
repeat an id are documents of their own, and conflict as their texts are equal; ties go by id, then
cluster; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import bpe
from granary.llm.common import small_batches, text_or_empty

CAPACITY = 2048
SHARD_ROWS = 4096
BYTES_PER_TOKEN = 4


def pack(items: Iterable[tuple[int, object, object]], capacity: int) -> list[tuple[int, int, int]]:
    """items: (size, source, cluster), none larger than capacity, by falling size. Returns for each
    its bin, its place in the bin, and the offset at which it starts there."""
    items = list(items)
    sources: dict[object, int] = {}
    shared = {k for k, n in Counter(c for _, _, c in items if c is not None).items() if n > 1}
    clusters: dict[object, int] = {}

    def bit(of: dict[object, int], key: object) -> int:
        return 0 if key is None else 1 << of.setdefault(key, len(of))

    order: list[tuple[int, int]] = []  # what a bin has left, and its number
    held: list[tuple[int, int]] = []  # bitmaps of a bin's sources and clusters
    filled: list[list[int]] = []  # documents and tokens in a bin
    out = []
    for size, source, cluster in items:
        s, c = bit(sources, source), bit(clusters, cluster) if cluster in shared else 0
        at = bisect_left(order, (size, -1))
        while at < len(order):
            has = held[order[at][1]]
            if not (has[0] & s or has[1] & c):
                break
            at += 1
        if at < len(order):
            left, k = order.pop(at)
        else:
            left, k = capacity, len(held)
            held.append((0, 0))
            filled.append([0, 0])
        out.append((k, filled[k][0], filled[k][1]))
        held[k] = (held[k][0] | s, held[k][1] | c)
        filled[k][0] += 1
        filled[k][1] += size
        if left > size:
            insort(order, (left - size, k))
    return out


def place(
    docs: DataFrame,
    capacity: int = CAPACITY,
    tokens: Column | None = None,
    text_col: str = "text",
    id_col: str = "doc_id",
    source_col: str = "source",
    cluster: Column | None = None,
    shard_rows: int = SHARD_ROWS,
    rows_of: int | None = None,
) -> DataFrame:
    """One row per piece: id, piece, start and n_tokens (of the document, its end token included),
    bin_id, place and offset in the bin. tokens: the size of a text, by default its bytes over
    BYTES_PER_TOKEN; cluster: what duplicates share, by default the hash of the text; rows_of: the number
    of docs' rows, if it is known."""
    if capacity < 1:
        raise ValueError("a bin must hold a token")
    tokens = F.ceil(F.octet_length(text_or_empty(text_col)) / BYTES_PER_TOKEN) if tokens is None else tokens
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        (F.coalesce(tokens, F.lit(0)).cast("bigint") + 1).alias("size"),
        F.col(source_col).cast("string").alias("source"),
        F.xxhash64(text_or_empty(text_col) if cluster is None else cluster).alias("cluster"),
    )
    shards = max(1, -(-(docs.count() if rows_of is None else rows_of) // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "cluster"), F.lit(shards)).cast("int"))
    schema = pa.schema([
        ("id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
        ("bin_id", pa.int64()), ("place", pa.int64()), ("offset", pa.int64()),
    ])

    def packed(shard: int, first: int, members: list[tuple]) -> tuple[int, pa.RecordBatch]:
        """members: id, size, source, cluster; first: the shard's bins before. Returns that after, and rows."""
        full, rests = [], []
        for key, size, source, cluster in members:
            whole, rest = divmod(size, capacity)
            full += [(key, i, i * capacity, capacity) for i in range(whole)]
            if rest:
                rests.append((rest, source, cluster, key, whole))
        rests.sort(key=lambda r: (-r[0], r[3] is None, r[3] or 0, r[2]))
        bins = pack(((r[0], r[1], r[2]) for r in rests), capacity)
        base, n = (shard << 32) + first, max((k for k, _, _ in bins), default=-1) + 1
        rows = [(r[3], r[4], r[4] * capacity, r[0], base + k, p, o) for r, (k, p, o) in zip(rests, bins, strict=True)]
        rows += [(*f, base + n + i, 0, 0) for i, f in enumerate(full)]
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        return first + n + len(full), made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, members = None, 0, []
        for batch in batches:
            for shard, *member in zip(*(batch[c].to_pylist() for c in ("shard", "id", "size", "source", "cluster")), strict=True):
                if shard != at or len(members) >= 2 * shard_rows:
                    if members:
                        first, made = packed(at, first, members)
                        yield made
                    at, first, members = shard, first if shard == at else 0, []
                members.append(member)
        if members:
            yield packed(at, first, members)[1]

    small_batches(docs.sparkSession)
    dealt = rows.repartition("shard").sortWithinPartitions("shard", "id", "cluster", "size", "source")
    kinds = "id bigint, piece bigint, start bigint, n_tokens bigint, bin_id bigint, place bigint, offset bigint"
    return dealt.select("shard", "id", "size", "source", "cluster").mapInArrow(run, kinds).withColumnRenamed("id", id_col)


def by_tokens(docs: DataFrame, capacity: int = CAPACITY, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``place`` with the sizes that byte-level BPE gives texts; clusters are of equal texts."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text_or_empty(text_col)).alias("copies"), F.col(text_col).alias("text")
    )
    sized = bpe.count(rows, "text", "n_ids")
    return place(sized, capacity, F.col("n_ids"), id_col="id", source_col="source", cluster=F.col("copies"), rows_of=docs.count()).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
