"""Document fingerprints from statistically improbable features.

Every 64-byte window of a text has a Shannon entropy, in one of 1001 classes. A first pass counts
the classes over all texts; the rarer a window's class, the better its rank. In each run of 64
windows the leftmost best-ranked one scores a point, and windows with enough points are the text's
features. Their hashes go, 160 to a filter, into a chain of 2048-bit Bloom filters, which is the
fingerprint. Two fingerprints are compared filter by filter: the bits they share, less those
expected by chance, over the most they could share; each filter of the shorter chain counts with
its best match.

Window entropies are exact integers, kept up to date as the window slides: a byte that enters or
leaves changes the sum by a function of how often it occurs in the other 63. Texts are worked on in
segments with enough overlap, so memory is bounded by the segment, not the text.

``compare_with_next`` pairs each document with the one that follows in descending id order. Rows
are dealt by ranges of the id and sorted within each; the first row of each range is also given to
the range before it, so no task needs more than its own range and one text of the next. Texts are read
twice: for the counts of classes and bytes, and for the fingerprints.

Defined results: a null text is empty; the empty text has no feature, and is like only itself
(likeness 1); a text without a window of middling entropy (all short ones) has one feature, its
whole self; ties of one id sort by text; null ids come last; one single row follows itself; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import chunks, small_batches, text_or_empty

WINDOW = 64
CLASSES = 1001
#: Windows of less entropy than this class say nothing about a text.
LEAST_CLASS = 100
POINTS = 16
PER_FILTER = 160
FILTER_BITS = 2048
PROBES = 5
#: The part of the way from chance to full overlap that still counts as chance.
CUTOFF = 0.1
SEGMENT = 1 << 18
CHUNK_BYTES = 4 << 20
#: A range of ids holds about so many bytes of text.
RANGE_BYTES = 16 << 20
#: There are no more ranges than this; of a larger corpus each holds more. A task reads its range as a
#: stream, so that is a matter of time, not of memory.
MOST_RANGES = 1 << 15
_NONE = np.uint32(2047)
_AT_BITS = 20


@lru_cache(maxsize=1)
def _steps() -> tuple[np.ndarray, np.ndarray]:
    """g(k) = k log2 k in fixed point, and g(k + 1) - g(k)."""
    k = np.arange(WINDOW + 1, dtype=np.float64)
    g = np.rint(np.where(k > 0, k * np.log2(np.maximum(k, 1)), 0) * (1 << 20)).astype(np.int64)
    return g, np.diff(g)


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """The entropy class of the window at each byte of data but the last 63."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int16)
    ahead, behind = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    g, step = _steps()
    first = int(g[np.bincount(data[:WINDOW], minlength=256)].sum())
    change = step[behind[WINDOW:]] - step[ahead[: len(data) - WINDOW]]
    total = np.concatenate([[first], first + np.cumsum(change)])
    # Entropy is log2(64) - total / 64, at most 6 bits.
    top = 6 * WINDOW << 20
    return ((top - total) * (CLASSES - 1) // top).astype(np.int16)


class Corpus:
    """Texts laid end to end; windows may not cross from one to the next."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.sizes)
        self.data = np.frombuffer(b"".join(texts), np.uint8)

    def segments(self) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(first, last, start, classes): windows from first to before last are this segment's;
        classes begin at start, and are -1 for windows that cross texts."""
        inside = np.ones(len(self.data), bool)
        for start, end in zip(self.ends - self.sizes, self.ends, strict=True):
            inside[max(start, end - WINDOW + 1) : end] = False
        for first in range(0, len(self.data), SEGMENT):
            last = min(first + SEGMENT, len(self.data))
            start, stop = max(0, first - WINDOW), min(len(self.data), last + 2 * WINDOW)
            found = entropy_classes(self.data[start:stop])
            classes = np.full(stop - start, -1, np.int16)
            classes[: len(found)] = found
            classes[~inside[start:stop]] = -1
            yield first, last, start, classes

    def histogram(self) -> np.ndarray:
        total = np.zeros(CLASSES, np.int64)
        for first, last, start, classes in self.segments():
            own = classes[first - start : last - start]
            total += np.bincount(own[own >= 0], minlength=CLASSES)
        return total

    def features(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text number and hash of each feature, in order."""
        least = np.clip((self.sizes - WINDOW + 1) // 8, 1, POINTS)
        found = [np.zeros(0, np.int64)]
        table = np.append(ranks, _NONE).astype(np.uint32)  # class -1 is the last entry
        for first, last, start, classes in self.segments():
            rank = table[classes]
            best = (rank << np.uint32(_AT_BITS)) | np.arange(len(rank), dtype=np.uint32)
            for shift in (1, 2, 4, 8, 16, 32):
                best[:-shift] = np.minimum(best[:-shift], best[shift:])
            runs = best[(classes >= 0) & (rank < _NONE)]
            points = np.bincount(runs & np.uint32((1 << _AT_BITS) - 1), minlength=len(rank))
            own = np.arange(first, last)
            points, rank = points[first - start : last - start], rank[first - start : last - start]
            likely = np.flatnonzero((points > 0) & (rank < _NONE))
            at = own[likely]
            of = np.searchsorted(self.ends, at, "right")
            found.append(at[points[likely] >= least[of]])
        at = np.concatenate(found)
        return np.searchsorted(self.ends, at, "right"), self._hashes(at)

    def _hashes(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for i in range(0, len(at), 1 << 14):
            rows = self.data[at[i : i + (1 << 14), None] + np.arange(WINDOW)]
            words = np.ascontiguousarray(rows).view(np.uint64)
            h = np.zeros(len(rows), np.uint64)
            for j in range(words.shape[1]):
                h = (h ^ words[:, j]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out[i : i + len(rows)] = h
        return out


def _bits(hashes: np.ndarray) -> np.ndarray:
    """PROBES bit numbers for each hash."""
    shifts = np.arange(PROBES, dtype=np.uint64) * np.uint64(11)
    return ((hashes[:, None] >> shifts) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def digests(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Each text's chain of filters: an array of shape (filters, FILTER_BITS / 64)."""
    corpus = Corpus(texts)
    of, hashes = corpus.features(ranks)
    counts = np.bincount(of, minlength=len(texts)) if len(of) else np.zeros(len(texts), np.int64)
    alone = np.flatnonzero((counts == 0) & (corpus.sizes > 0))
    if len(alone):
        own = [int.from_bytes(hashlib.blake2b(texts[i], digest_size=8).digest(), "little") for i in alone]
        of = np.concatenate([of, alone])
        hashes = np.concatenate([hashes, np.array(own, np.uint64)])
        order = np.argsort(of, kind="stable")
        of, hashes = of[order], hashes[order]
        counts[alone] = 1
    chains = -(-counts // PER_FILTER)
    first = np.concatenate([[0], np.cumsum(chains)])
    place = np.arange(len(of)) - np.concatenate([[0], np.cumsum(counts)])[of]
    row = first[of] + place // PER_FILTER
    filters = np.zeros((int(first[-1]), FILTER_BITS), bool)
    filters[row[:, None], _bits(hashes)] = True
    packed = np.packbits(filters, axis=1).view(np.uint64)
    return [packed[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def encode(digest: np.ndarray) -> str:
    return f"{len(digest)}:{base64.b64encode(digest.tobytes()).decode()}"


def _one_way(a: np.ndarray, b: np.ndarray) -> float:
    """Mean over a's filters of the best normalised overlap with one of b's."""
    in_a, in_b = np.bitwise_count(a).sum(1).astype(float), np.bitwise_count(b).sum(1).astype(float)
    best = np.zeros(len(a))
    for i in range(len(a)):
        shared = np.bitwise_count(a[i] & b).sum(1)
        most = np.minimum(in_a[i], in_b)
        chance = in_a[i] * in_b / FILTER_BITS
        floor = chance + CUTOFF * (most - chance)
        best[i] = np.clip((shared - floor) / np.maximum(most - floor, 1e-9), 0, 1).max()
    return float(best.mean())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 (no more alike than by chance) to 1 (one fingerprint)."""
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) == len(b):
        return (_one_way(a, b) + _one_way(b, a)) / 2
    return _one_way(a, b) if len(a) < len(b) else _one_way(b, a)


def fit(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """The rank of each entropy class, from its count over all texts: 0 is the rarest; and the bytes of
    all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, CHUNK_BYTES):
            corpus = Corpus([t.encode() for t in table["t"].to_pylist()])
            total = corpus.histogram()
            seen = np.flatnonzero(total)
            found = np.append(seen, -1), np.append(total[seen], corpus.sizes.sum())  # -1: the bytes
            yield pa.RecordBatch.from_pydict({"class": found[0].astype(np.int32), "n": found[1]})

    small_batches(docs.sparkSession)
    counted = docs.select(text_or_empty(text_col).alias("t")).mapInArrow(run, "class int, n bigint")
    found = {r["class"]: r["n"] for r in counted.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # CLASSES + 1 rows at most
    total = np.array([found.get(c, 0) for c in range(CLASSES)], np.int64)
    ranks = np.empty(CLASSES, np.uint32)
    ranks[np.lexsort((np.arange(CLASSES), total))] = np.arange(CLASSES, dtype=np.uint32)
    ranks[:LEAST_CLASS] = _NONE
    return ranks, found.get(-1, 0)


def fit_ranks(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    return fit(docs, text_col)[0]


def fingerprint(docs: DataFrame, ranks: np.ndarray, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """docs with a fingerprint column; a column of that name is replaced."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    fields = [x for x in docs.schema.fields if x.name != out_col]
    names = [x.name for x in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, CHUNK_BYTES):
            made = [encode(d) for d in digests([t.encode() for t in table["__text"].to_pylist()], shared.value)]
            yield from table.select(names).append_column(out_col, pa.array(made)).combine_chunks().to_batches()

    rows = docs.select(*[F.col(f"`{x}`") for x in names], text_or_empty(text_col).alias("__text"))
    return rows.mapInArrow(run, T.StructType([*fields, T.StructField(out_col, T.StringType())]))


def _range_of(key: Column, bounds: list) -> Column:
    """How many of the descending bounds are not under key: a binary search, as the bounds may be
    many. Null keys come after all bounds."""
    if not bounds:
        return F.lit(0)
    table, steps = F.lit(bounds), [1 << i for i in reversed(range(len(bounds).bit_length()))]
    found = F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda at, step: F.when((at + step <= len(bounds)) & (F.try_element_at(table, at + step) > key), at + step).otherwise(at),
    )
    return F.when(key.isNull(), F.lit(len(bounds))).otherwise(found)


def _edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by the start of the text that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, ranks: np.ndarray, text_col: str = "text", id_col: str = "doc_id", n_bytes: int | None = None) -> DataFrame:
    """For each row: its size, edited text's hash, both fingerprints, and the likeness of its own to
    the edited text's and to the next document's. n_bytes: the bytes of all texts, if they are known."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    if n_bytes is None:
        n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // RANGE_BYTES)), MOST_RANGES)
    cuts = [i / n for i in range(n - 1, 0, -1)]
    bounds = rows.agg(F.percentile_approx("id", F.lit(cuts), min(10 * n, MOST_RANGES))).first()[0] if cuts else []
    bounds = sorted(set(bounds or []), reverse=True)
    rows = rows.withColumn("part", _range_of(F.col("id"), bounds))
    # As many rows as ranges: the first id of each, and so the one that follows each range's last.
    firsts = {r.part: r.id for r in rows.groupBy("part").agg(F.max("id").alias("id")).collect()}
    order = sorted(firsts)
    before = [(firsts[part], order[i - 1]) for i, part in enumerate(order)]
    guests = F.broadcast(spark.createDataFrame(before, "first bigint, host int"))
    own = F.struct("part", F.lit(False).alias("guest"))
    copies = F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("host").alias("part"), F.lit(True).alias("guest"))))
    dealt = (
        rows.join(guests, F.col("id").eqNullSafe(F.col("first")), "left")
        .select("id", "text", F.inline(copies))
        .repartitionById(max(n, 1), F.col("part").cast("int"))
        .sortWithinPartitions("part", "guest", F.col("id").desc_nulls_last(), "text")
    )
    shared = spark.sparkContext.broadcast(ranks)
    out = pa.schema([
        ("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ])

    def compared(pairs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        """pairs: id, text and the text that follows, which is the next pair's own or the last one's."""
        own = [t.encode() for _, t, _ in pairs]
        own.append(pairs[-1][2].encode())
        edited = [_edited(t, f).encode() for _, t, f in pairs]
        found = digests(own + edited, shared.value)
        mine, theirs = found[: len(own)], found[len(own) :]
        return pa.RecordBatch.from_arrays([
            pa.array([k for k, _, _ in pairs], pa.int64()),
            pa.array([len(t) for _, t, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
            pa.array([encode(d) for d in mine[:-1]]),
            pa.array([encode(d) for d in theirs]),
            pa.array([likeness(a, b) for a, b in zip(mine[:-1], theirs, strict=True)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(mine[:-1], mine[1:], strict=True)], pa.float64()),
        ], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int | None, str, str]] = []
        held, before = 0, None  # before: the row whose next one has not come yet
        for table in chunks(batches, CHUNK_BYTES):
            for part, guest, key, text in zip(*(table[c].to_pylist() for c in ("part", "guest", "id", "text")), strict=True):
                if before is not None and before[0] == part:
                    waiting.append((before[1], before[2], text))
                    held += len(before[2])
                    if held >= CHUNK_BYTES // 2:
                        yield compared(waiting)
                        waiting, held = [], 0
                elif waiting:  # a range ends: the next pair's text is not the last one's following
                    yield compared(waiting)
                    waiting, held = [], 0
                before = None if guest else (part, key, text)
        if waiting:
            yield compared(waiting)

    kinds = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("part", "guest", "id", "text").mapInArrow(run, kinds).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ranks, n_bytes = fit(docs)
    return compare_with_next(docs, ranks, n_bytes=n_bytes)
