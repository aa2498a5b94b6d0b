"""Near-duplicate detection on word shingles by SetSketch registers.

1. Every document's set of shingles becomes m registers: for each of m hash functions the minimum of
   exponential values over the set, kept as an exponent of base b, truncated to its range. Registers
   of a union are the larger of both (mergeable), and similar sets agree in many (locality-sensitive).
2. Documents with equal sets are one class. Bands of registers put classes into buckets. Members of a
   bucket whose Jaccard similarity may reach the threshold, by the joint likelihood of their registers
   and set sizes, hang together (in a very large bucket, all members do); a bucket yields at most as
   many edges as members, never their pairs. What hangs together is a candidate group.
3. Each group is dealt to blocks of bounded size. Within a block, pairs that the likelihood does not
   rule out are verified on the full sets; pairs that are connected already are passed over. A block
   emits one row a document. Every member's set is computed once, and written.
4. Groups of more than one block go on. Some members of each connected part meet until the parts no
   longer merge. What is left between the parts is searched by prefixes: all members of a group sort
   their shingles in one order, those that a few of its members share last; two sets that reach the
   threshold have their first common shingle among the first (1 - t) n + 1 of the larger and the first
   (1 - 2t / (1 + t)) n + 1 of the smaller one. So members of different parts meet by such a shingle
   only, however many they are; pages of one template whose own words set them apart never do. Every
   pair that meets is verified, in blocks, and a task's rows are at most two for each such pair.
5. Connected components of the verified links are the result.

Sets are compared by the 64-bit hashes of their shingles. A link between documents that share no
bucket, directly or through others, would be missed: with the default bands less than one in a
million at the threshold. All else is exact: the order of the shingles decides the work, not the result.

Defined results: a null or empty text, or one of white space only, has no shingle and is linked with
nothing; fewer words than a shingle has make one shingle; rows that share an id are one document; rows
without an id are linked with nothing, and stay; an empty table gives an empty result; extra columns
pass through ``deduplicate``, names that begin with ``__`` are reserved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import bloom
from granary.llm.common import chunks, materialise, small_batches, text_or_empty
from granary.llm.components import components

CHUNK_BYTES = 4 << 20
#: SetSketch's base, rate and largest register value.
BASE, RATE, LARGEST = 1.001, 20.0, (1 << 16) - 1
#: Standard deviations under the threshold at which the likelihood rules a pair out: one of equal sizes
#: at the threshold with probability 5e-8 (80 registers, 0.85) or 3e-8 (112 registers, 0.80).
MARGIN = 6.0
BLOCK_ROWS, BLOCK_SHINGLES = 192, 2_000_000
#: Members of a group whose shingles are counted for its order: about so many, with so many shingles
#: together. They only make a good order likely; any order gives the same links.
ORDER_ROWS, ORDER_SHINGLES = 64, 1_000_000
#: Members that are sorted in one task by their group's order.
SORT_ROWS = 1024
#: A task that compares sets reads about so many bytes of them.
TASK_BYTES = 32 << 20
#: A bucket of more members is taken to be of one kind, and hangs together as a whole.
BUCKET_ROWS = 512
#: Members of each connected part that stand for it while a large group's parts are merged.
SPEAKERS = 4


@dataclass(frozen=True)
class Config:
    """words: words of a shingle; percent: the least Jaccard similarity, in hundredths."""

    words: int = 5
    percent: int = 80
    bands: int = 28
    rows: int = 4

    @property
    def registers(self) -> int:
        return self.bands * self.rows


_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_MIX1, _MIX2, _MIX3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(bits: int) -> np.ndarray:
    """Powers of an odd number, 2**bits of them."""
    out = np.full(1 << bits, 0xD6E8FEB86659FD93, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingles(text: bytes, words: int) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    data = np.frombuffer(text.lower(), np.uint8)  # bytes.lower() knows A to Z only
    inside = ~_SPACES[data]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    letters = data[inside].astype(np.uint64) + np.uint64(1)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    hashes = _mix(np.add.reduceat(letters * _powers(max(6, int(sizes.max()).bit_length()))[place], first))
    width = min(words, len(hashes))
    out = np.full(len(hashes) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mix(out * _MIX3 + hashes[i : i + len(out)])
    return np.unique(out)


@lru_cache(maxsize=4)
def _functions(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(42)
    return rng.integers(0, 1 << 31, (m, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, (m, 1), dtype=np.uint32)


def sketch(hashes: np.ndarray, m: int) -> np.ndarray:
    """The m registers of a set that is not empty."""
    by, plus = _functions(m)
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(m, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1024):
        h = low[None, i : i + 1024] * by
        h += plus
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        h *= np.uint32(0x297A2D39)
        np.minimum(least, h.min(axis=1), out=least)
    value = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / math.log(BASE)), 0, LARGEST).astype(np.uint16)


def may_reach(percent: int, mine: np.ndarray, others: np.ndarray, n: int | np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the most likely similarity of a set to each of others (or of each set to its other),
    given all registers and both sizes, is not MARGIN standard deviations or more under the threshold.
    The log likelihood is concave, so its slope at that bound tells on which side its maximum is."""
    m = mine.shape[-1]
    above, below = (mine > others).sum(-1), (mine < others).sum(-1)
    same = m - above - below
    u, v = n / (n + sizes), sizes / (n + sizes)
    t = percent / 100
    low = max(0.0, t - MARGIN * math.sqrt(t * (1 - t) / m))
    low = np.minimum(low, np.minimum(u / v, v / u) * (1 - 1e-9))
    c = (BASE - 1) / BASE

    def p(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = 1 - c * x
        return np.maximum(-np.log(rest) / math.log(BASE), 1e-12), c / (math.log(BASE) * rest)

    (p_above, d_above), (p_below, d_below) = p(u - v * low), p(v - u * low)
    p_same = np.maximum(1 - p_above - p_below, 1e-12)
    slope = same * (v * d_above + u * d_below) / p_same - above * v * d_above / p_above - below * u * d_below / p_below
    return slope >= 0


def link(percent: int, labels: np.ndarray, query: np.ndarray, sets: list[np.ndarray], registers: np.ndarray) -> np.ndarray:
    """Each row's part after all links between a query row and any row: the least label in it.
    Rows of equal labels are connected before."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    _, part = np.unique(labels, return_inverse=True)
    least = np.unique(labels)
    vocabulary, where = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(n)])
    mark = np.zeros(len(vocabulary), np.uint8)
    for x in np.flatnonzero(query):
        others = np.flatnonzero(part != part[x])
        if not len(others):
            continue
        fits = 100 * np.minimum(n[others], n[x]) >= percent * np.maximum(n[others], n[x])
        others = others[fits]
        if len(others):
            others = others[may_reach(percent, registers[x], registers[others], n[x], n[others])]
        if not len(others):
            continue
        mark[where[first[x] : first[x + 1]]] = 1
        if 4 * len(others) > len(sets):
            shared = np.add.reduceat(mark[where], first[:-1], dtype=np.int64)[others]
        else:
            shared = np.array([int(mark[where[first[o] : first[o + 1]]].sum(dtype=np.int64)) for o in others])
        mark[where[first[x] : first[x + 1]]] = 0
        linked = others[100 * shared >= percent * (n[x] + n[others] - shared)]
        if len(linked):
            met = np.unique(np.append(part[linked], part[x]))
            part[np.isin(part, met)] = met[0]  # parts are numbered by label
    return least[part]


def _sketched(docs: DataFrame, config: Config) -> DataFrame:
    """id, n, s1 and s2 (a hash of the set), registers; null where the set is empty."""
    words, m = config.words, config.registers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, CHUNK_BYTES):
            n, one, two, made = [], [], [], []
            for text in table["text"].to_pylist():
                s = shingles(text.encode(), words)
                n.append(len(s))
                some = len(s) > 0
                one.append(int(_mix(s + _MIX3).sum(dtype=np.uint64).view(np.int64)) if some else None)
                two.append(int(_mix(s ^ _MIX2).sum(dtype=np.uint64).view(np.int64)) if some else None)
                made.append(sketch(s, m).tobytes() if some else None)
            yield pa.RecordBatch.from_arrays(
                [table["id"].combine_chunks(), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(made, pa.binary())],
                ["id", "n", "s1", "s2", "registers"],
            )

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, "id bigint, n bigint, s1 bigint, s2 bigint, registers binary")


def _with_sets(docs: DataFrame, members: DataFrame, config: Config) -> DataFrame:
    """members (id and other columns) with their sets and registers, from their whole texts."""
    words, m = config.words, config.registers
    fields = [f for f in members.schema.fields]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, CHUNK_BYTES):
            sets = [shingles(t.encode(), words) for t in table["text"].to_pylist()]
            out = table.select(names)
            out = out.append_column("hashes", pa.array([s.tobytes() for s in sets], pa.binary()))
            made = [sketch(s, m).tobytes() if len(s) else b"" for s in sets]
            yield from out.append_column("registers", pa.array(made, pa.binary())).combine_chunks().to_batches()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    # Most texts are no members': a filter keeps them out of the shuffle.
    n_blocks = bloom.blocks_for(members.count())
    wanted = bloom.build(members.select(F.xxhash64("id").alias("__key")), "__key", n_blocks)
    likely = bloom.probe(docs.withColumn("__key", F.xxhash64("id")), "__key", wanted, "__maybe", n_blocks)
    rows = likely.where("__maybe").select("id", "text").join(members.hint("merge"), "id").select(*names, "text")
    return rows.mapInArrow(run, f"{kinds}, hashes binary, registers binary").where(F.length("hashes") > 0)


def _linked(rows: DataFrame, config: Config, keys: list[str], shingles_: int) -> DataFrame:
    """rows: keys of a task, id, label, query, hashes, registers; shingles_: how many they have together.
    Returns (a, b): links between labels, one for each part that met another in its task."""
    percent = config.percent

    def one(task: list[tuple]) -> Iterator[tuple[int, int]]:
        labels = np.array([r[0] for r in task], np.int64)
        after = link(
            percent, labels, np.array([r[1] for r in task], bool),
            [np.frombuffer(r[2], np.uint64) for r in task],
            np.stack([np.frombuffer(r[3], np.uint16) for r in task]),
        )
        for a, b in {(int(a), int(b)) for a, b in zip(labels, after, strict=True) if a != b}:
            yield a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at, found = [], None, []
        for batch in batches:
            for *key, label, query, hashes, registers in zip(*(batch[c].to_pylist() for c in (*keys, "label", "query", "hashes", "registers")), strict=True):
                if key != at:
                    if len(task) > 1:
                        found.extend(one(task))
                    task, at = [], key
                    if len(found) > 10_000:
                        yield _pairs(found)
                        found = []
                task.append((label, query, hashes, registers))
        if len(task) > 1:
            found.extend(one(task))
        yield _pairs(found)

    small_batches(rows.sparkSession)
    # The tasks of one group go to partitions next to each other, so that no two of a large group meet.
    group, *numbers = keys
    place = F.xxhash64(group)
    for step, number in zip((1, 31), reversed(numbers), strict=False):
        place = place + F.col(number) * step
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-8 * shingles_ // TASK_BYTES))
    dealt = rows.repartitionById(n, F.pmod(place, F.lit(n)).cast("int")).sortWithinPartitions(*keys)
    return dealt.select(*keys, "label", "query", "hashes", "registers").mapInArrow(run, "a bigint, b bigint")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def alike(percent: int, n: np.ndarray, registers: np.ndarray) -> np.ndarray:
    """Each member's part of a bucket, as the place of the part's first member, when those whose
    likelihood lets them link hang together."""
    part = np.arange(len(n))
    for x in range(len(n)):
        others = np.flatnonzero(part != part[x])
        others = others[100 * np.minimum(n[others], n[x]) >= percent * np.maximum(n[others], n[x])]
        if len(others):
            met = np.unique(np.append(part[others[may_reach(percent, registers[x], registers[others], n[x], n[others])]], part[x]))
            if len(met) > 1:
                part[np.isin(part, met)] = met[0]
    return part


def _bucket_edges(rows: DataFrame, config: Config) -> DataFrame:
    """rows: key of a bucket, id, n, registers. Returns edges (a, b) that make the parts of each bucket."""
    percent, m = config.percent, config.registers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, at = [], None
        pairs: list[tuple] = []  # of buckets of two, for one call
        found: list[tuple[int, int]] = []

        def close() -> None:
            if len(bucket) == 2:
                pairs.append((*bucket[0], *bucket[1]))
            elif len(bucket) > 2:
                n = np.array([r[1] for r in bucket], np.int64)
                registers = np.frombuffer(b"".join(r[2] for r in bucket), np.uint16).reshape(-1, m)
                found.extend((bucket[i][0], bucket[p][0]) for i, p in enumerate(alike(percent, n, registers)) if i != p)

        def paired() -> Iterator[tuple[int, int]]:
            if not pairs:
                return
            one, two = (np.frombuffer(b"".join(r[k] for r in pairs), np.uint16).reshape(-1, m) for k in (2, 5))
            n, o = (np.array([r[k] for r in pairs], np.int64) for k in (1, 4))
            keep = (100 * np.minimum(n, o) >= percent * np.maximum(n, o)) & may_reach(percent, one, two, n, o)
            yield from ((pairs[i][0], pairs[i][3]) for i in np.flatnonzero(keep))
            pairs.clear()

        for batch in batches:
            for key, *row in zip(*(batch[c].to_pylist() for c in ("key", "id", "n", "registers")), strict=True):
                if key != at:
                    close()
                    bucket, at = [], key
                bucket.append(row)
            if len(pairs) + len(found) > 10_000:
                yield _pairs([*found, *paired()])
                found.clear()
        close()
        yield _pairs([*found, *paired()])

    small_batches(rows.sparkSession)
    return rows.repartition("key").sortWithinPartitions("key").select("key", "id", "n", "registers").mapInArrow(run, "a bigint, b bigint")


def _candidate_groups(classes: DataFrame, config: Config, bucket_rows: int) -> DataFrame:
    """(id, grp, n) of the classes that hang together with another by a bucket."""
    width = 2 * config.rows
    band = F.explode(F.sequence(F.lit(0), F.lit(config.bands - 1)))
    banded = classes.select("id", "registers", band.alias("band"))
    key = F.xxhash64("band", F.substring(F.col("registers"), F.col("band") * width + 1, F.lit(width)))
    keyed = banded.select("id", key.alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("size"))
    buckets = materialise(buckets.where("size > 1"), "buckets", narrow=True)
    n_blocks = bloom.blocks_for(buckets.count())
    filter_ = bloom.build(buckets.select(F.col("key").alias("__key")), "__key", n_blocks)
    shared = bloom.probe(keyed, "key", filter_, "__maybe", n_blocks).where("__maybe")
    members = materialise(shared.select("id", "key").join(buckets, "key"), "bucket_members", narrow=True)
    large = members.where(F.col("size") > bucket_rows).where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
    small = members.where(F.col("size") <= bucket_rows).select("key", "id").join(classes.select("id", "n", "registers").hint("merge"), "id")
    edges = large.unionByName(_bucket_edges(small, config)).distinct()
    groups = components(edges).select(F.col("node").alias("id"), F.col("label").alias("grp"))
    # Rows that share an id may be of several classes.
    return groups.join(classes.select("id", "n"), "id").groupBy("id", "grp").agg(F.max("n").alias("n"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, grp, n, label) after links between labels."""
    moved = components(links).select(F.col("node").alias("label"), F.col("label").alias("to"))
    cols = labels.columns
    return materialise(labels.join(moved, "label", "left").withColumn("label", F.coalesce("to", "label")).select(*cols), "merged", narrow=True)


def _blocks(rows: DataFrame, most_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows (id, grp, n, ...) with the number of blocks of their group and their own block; others of these
    names are replaced."""
    rows = rows.drop("blocks", "block")
    totals = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("__rows"), F.sum("n").alias("__n"))
    parts = F.greatest(F.ceil(F.col("__rows") / most_rows), F.ceil(F.col("__n") / BLOCK_SHINGLES)).cast("int")
    totals = materialise(totals.select("grp", parts.alias("blocks")), "blocks", narrow=True)
    return rows.join(totals, "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def prefix_sizes(percent: int, n: int) -> tuple[int, int]:
    """How many of a set's n shingles, in the common order, meet those of sets that are not smaller, and
    those of any set that it may be linked with."""
    return n + 1 - -(-2 * percent * n // (100 + percent)), n + 1 - -(-percent * n // 100)


def _orders(members: DataFrame) -> DataFrame:
    """members: grp, rows (of the group), id, hashes. (grp, hashes, times): the shingles that more than one of
    a few members of a group have, sorted, and how many of them have each."""
    every = F.greatest(F.lit(1), F.floor(F.col("rows") / ORDER_ROWS))
    few = members.where(F.pmod(F.xxhash64("id", F.lit(1)), every) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            if held:
                found, times = np.unique(np.concatenate(held), return_counts=True)
                found, times = found[times > 1], np.minimum(times[times > 1], 255).astype(np.uint8)
                yield pa.RecordBatch.from_pydict({"grp": pa.array([at], pa.int64()), "hashes": pa.array([found.tobytes()], pa.binary()), "times": pa.array([times.tobytes()], pa.binary())})

        for batch in batches:
            for grp, hashes in zip(batch["grp"].to_pylist(), batch["hashes"].to_pylist(), strict=True):
                if grp != at:
                    yield from counted()
                    at, held, size = grp, [], 0
                size += len(hashes) // 8
                if size <= ORDER_SHINGLES:
                    held.append(np.frombuffer(hashes, np.uint64))
        yield from counted()

    return few.repartition("grp").sortWithinPartitions("grp", "id").select("grp", "hashes").mapInArrow(run, "grp bigint, hashes binary, times binary")


def _prefixes(members: DataFrame, orders: DataFrame, groups: DataFrame, config: Config) -> DataFrame:
    """members: grp, rows, id, label, main, n, hashes. (key, grp, id, label, main, n, first): the shingles by which
    each may meet another member of its group, as keys; first: whether it also meets larger sets by this one."""
    percent = config.percent
    chunks_ = F.ceil(F.col("rows") / SORT_ROWS).cast("int")
    none = F.lit(None)
    own = members.select(
        "grp", F.pmod(F.xxhash64("id"), chunks_).cast("int").alias("chunk"), F.lit(1).alias("kind"), "id", "label", "main", "n", "hashes", none.cast("binary").alias("times")
    )
    shared = orders.join(groups, "grp").select(
        "grp", F.explode(F.sequence(F.lit(0), chunks_ - 1)).alias("chunk"), F.lit(0).alias("kind"),
        *[none.cast(k).alias(c) for c, k in (("id", "bigint"), ("label", "bigint"), ("main", "boolean"), ("n", "bigint"))], "hashes", "times",
    )
    empty = np.zeros(0, np.uint64), np.zeros(0, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, common, times = None, *empty
        for batch in batches:
            out: list[tuple[np.ndarray, int, int, int, int, bool, int]] = []
            for grp, chunk, kind, id_, label, main, n, hashes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (grp, chunk) != at:
                    at, (common, times) = (grp, chunk), empty
                found = np.frombuffer(hashes, np.uint64)
                if kind == 0:
                    common, times = found, np.frombuffer(counts, np.uint8)
                    continue
                own_times = np.zeros(len(found), np.uint8)
                if len(common):
                    place = np.minimum(np.searchsorted(common, found), len(common) - 1)
                    own_times = np.where(common[place] == found, times[place], 0)
                mixed = _mix(found + _MIX2)
                index, probe = prefix_sizes(percent, len(found))
                keys = mixed[np.lexsort((mixed, own_times))[:probe]]
                out.append((_mix(keys ^ np.uint64(grp & 0xFFFFFFFFFFFFFFFF)).view(np.int64), index, grp, id_, label, main, n))
            if out:
                many = [len(keys) for keys, *_ in out]
                repeated = {c: pa.array(np.repeat([r[k] for r in out], many)) for k, c in ((2, "grp"), (3, "id"), (4, "label"), (5, "main"), (6, "n"))}
                first = np.concatenate([np.arange(len(keys)) < index for keys, index, *_ in out])
                yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate([r[0] for r in out])), **repeated, "first": pa.array(first)})

    small_batches(members.sparkSession)
    dealt = own.unionByName(shared).repartition("grp", "chunk").sortWithinPartitions("grp", "chunk", "kind")
    return dealt.mapInArrow(run, "key bigint, grp bigint, id bigint, label bigint, main boolean, n bigint, first boolean")


def _meeting(members: DataFrame, groups: DataFrame, config: Config) -> DataFrame:
    """members: grp, rows, id, label, main, n, hashes; groups: grp, rows. (grp, a, b) of the members of different
    parts that meet by a prefix, a's set not being the larger. main: whether a member is in its group's
    largest part."""
    orders = materialise(_orders(members), "orders")
    keys = materialise(_prefixes(members, orders, groups, config), "prefixes")
    several = keys.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("first").alias("any")).where("low < high and any")
    keys = materialise(keys.join(several.select("key"), "key", "left_semi"), "meetings")
    small, large = keys.where("first").alias("x"), keys.alias("y")

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        fits = (F.col("x.label") != F.col("y.label")) & (100 * F.col("x.n") >= config.percent * F.col("y.n"))
        order = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))
        return x.join(y, (F.col("x.key") == F.col("y.key")) & fits & order).select("x.grp", F.col("x.id").alias("a"), F.col("y.id").alias("b"))

    # Members of one part need not meet, so those of the largest part meet only the others.
    return met(small.where("not main"), large).unionByName(met(small.where("main"), large.where("not main"))).distinct()


def _verified(docs: DataFrame, members: DataFrame, config: Config, most_rows: int) -> DataFrame:
    """(id, label) of the members (id, grp, n) after all verified links within their groups."""
    labels = materialise(_blocks(members, most_rows).withColumn("label", F.col("id")), "members", narrow=True)
    sets = materialise(_with_sets(docs, labels.select("id", "grp", "blocks", "block"), config), "sets")

    def links_of(rows: DataFrame, keys: list[str]) -> DataFrame:
        """rows, of groups of several blocks: keys, id, n, label, query."""
        n = rows.agg(F.sum("n")).first()[0] or 0
        tasks = rows.select("id", *keys, "label", "query").join(sets.where("blocks > 1").select("id", "hashes", "registers"), "id")
        return materialise(_linked(tasks, config, keys, n), "links", narrow=True)

    n = labels.agg(F.sum("n")).first()[0] or 0
    first = sets.select("id", "grp", "block", F.col("id").alias("label"), F.lit(True).alias("query"), "hashes", "registers")
    labels = _merged(labels, materialise(_linked(first, config, ["grp", "block"], n), "links", narrow=True))
    large = labels.where("blocks > 1")
    if large.isEmpty():
        return labels.select("id", "label")
    rest = labels.where("blocks = 1").select("id", "label")
    large = materialise(large.select("id", "grp", "n", "label"), "large", narrow=True)
    # Some members of each part meet, until no parts merge or all have met in one block.
    for _ in range(20):
        rank = F.row_number().over(_of_part())
        speakers = _blocks(large.withColumn("__rank", rank).where(F.col("__rank") <= SPEAKERS).drop("__rank"), most_rows)
        speakers = materialise(speakers.withColumn("query", F.lit(True)), "speakers", narrow=True)
        links = links_of(speakers, ["grp", "block"])
        if links.isEmpty():
            break
        large = _merged(large, links)
        if speakers.where("blocks > 1").isEmpty():
            break
    # Members of different parts that may still be linked meet by prefixes.
    parts = large.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("size"))
    main = parts.groupBy("grp").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.sum("size").alias("rows"), F.count(F.lit(1)).alias("parts"))
    main = materialise(main.where("parts > 1").drop("parts"), "main", narrow=True)
    open_ = large.join(main, "grp").withColumn("main", F.col("label") == F.col("main"))
    open_ = materialise(_blocks(open_, most_rows), "open", narrow=True)
    if open_.isEmpty():
        return large.select("id", "label").unionByName(rest)
    meeting = _meeting(open_.join(sets.where("blocks > 1").select("id", "hashes"), "id"), main.select("grp", "rows"), config)
    meeting = materialise(meeting, "meeting", narrow=True)
    place = lambda side, name: open_.select(F.col("id").alias(side), F.col("block").alias(name))
    asked = meeting.join(place("a", "q"), "a").join(place("b", "block"), "b")
    both = asked.select("grp", "q", "block", F.col("a").alias("id"), F.lit(True).alias("query")).unionByName(
        asked.select("grp", "q", "block", F.col("b").alias("id"), F.lit(False).alias("query"))
    )
    tasks = both.groupBy("grp", "q", "block", "id").agg(F.max("query").alias("query")).join(open_.select("id", "n", "label"), "id")
    links = links_of(materialise(tasks, "tasks", narrow=True), ["grp", "q", "block"])
    return _merged(large, links).select("id", "label").unionByName(rest)


def _of_part():
    from pyspark.sql import Window

    return Window.partitionBy("grp", "label").orderBy(F.xxhash64("id"), "id")


def find(
    docs: DataFrame,
    config: Config = Config(),  # noqa: B008
    text_col: str = "text",
    id_col: str = "doc_id",
    most_rows: int = BLOCK_ROWS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the least id that its links reach) and
    kept (whether that is its own)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    sketched = materialise(_sketched(rows, config), "sketches")
    some = sketched.where("s1 is not null and id is not null")
    classes = some.groupBy("s1", "s2").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("registers").alias("registers")
    )
    classes = materialise(classes, "classes", narrow=True)
    members = _candidate_groups(classes, config, bucket_rows)
    labels = _verified(rows.where(F.col("id").isNotNull()), members, config, most_rows).where("id <> label")
    # Rows that share an id but not their sets connect their classes.
    sets = F.struct("s1", "s2")
    shared = some.groupBy("id").agg(F.min(sets).alias("low"), F.max(sets).alias("high")).where("low <> high").select("id")
    shared = materialise(shared, "shared_ids", narrow=True)
    if not shared.isEmpty():
        own = some.select(F.col("id").alias("b"), "s1", "s2").join(shared.withColumnRenamed("id", "b"), "b")
        own = own.join(classes.select(F.col("id").alias("a"), "s1", "s2"), ["s1", "s2"]).select("a", "b")
        edges = labels.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(own)
        labels = components(edges).select(F.col("node").alias("id"), "label").where("id <> label")
    # Only classes of several rows, or linked to another, have a component that is not their own id.
    of_class = classes.join(labels.groupBy("id").agg(F.min("label").alias("label")), "id", "left").where("copies > 1 or label is not null")
    of_class = materialise(of_class.select("s1", "s2", F.coalesce("label", "id").alias("component")), "components", narrow=True)
    return sketched.join(of_class, ["s1", "s2"], "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
        (F.col("id").isNull() | (F.coalesce("component", "id") == F.col("id"))).alias("kept"),
    )


def deduplicate(docs: DataFrame, config: Config = Config(), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:  # noqa: B008
    """The rows of docs that stay: of each component the document with the least id. A filter lets most
    rows pass; the others meet the ids that go in an exact join."""
    gone = materialise(find(docs, config, text_col, id_col).where("not kept").select(F.col(id_col).alias("__gone")).distinct(), "gone", narrow=True)
    n_blocks = bloom.blocks_for(gone.count())
    filter_ = bloom.build(gone.withColumn("__key", F.xxhash64("__gone")), "__key", n_blocks)
    rows = bloom.probe(docs.withColumn("__key", F.xxhash64(F.col(id_col).cast("bigint"))), "__key", filter_, "__maybe", n_blocks)
    stay = rows.where("__maybe").join(gone, F.col(id_col).cast("bigint") == F.col("__gone"), "left_anti")
    return rows.where("not __maybe").select(*docs.columns).unionByName(stay.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find(docs, Config(words=3, percent=85, bands=20))
