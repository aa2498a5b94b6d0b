"""Language identification: averaged hashed subword embeddings and a linear softmax.

Features are the byte n-grams of the lower-cased text, hashed into buckets. A text's vector is the
mean of its buckets' embeddings; a linear layer and a softmax turn it into probabilities. Training is
stochastic gradient descent in numpy on a sample of labelled rows: about ``PER_LANG`` of each label, or
with many labels as many as make ``MOST_ROWS`` together, but never under ``LEAST_ROWS``. Only rows are
sampled: every label is learnt, and each row counts with its whole text. What the driver holds of a row
is bounded: a text of up to ``WHOLE`` bytes, or a longer one's n-gram counts and pieces drawn from all
of it. A fifth of the sample is kept for calibration: its texts and short pieces of them set the
softmax's temperature and the probability under which a prediction is rejected.

Prediction reads whole texts. As the mean and the layer are linear, each bucket's share of the scores is
one row of a small table; with more labels than an embedding has dimensions, the table is that of the
embeddings, so the model's size hardly grows with the labels.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and is rejected; so is
every text where no labelled row exists. Repeated rows get one answer; rows with a null label never
train; an empty table gives an empty result; ``classify`` passes other columns through and replaces
columns that have its outputs' names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import chunks, small_batches

BUCKETS = 1 << 16
DIM = 16
ORDERS = (1, 2, 3, 4)
PAD = max(ORDERS) - 1
#: Rows that train: so many of each label, of all labels together, and of each label at least.
PER_LANG, MOST_ROWS, LEAST_ROWS = 1000, 40_000, 50
#: Longer texts come to the driver as counts of n-grams and so many pieces of each size.
WHOLE, PIECES_EACH = 1 << 16, 8
#: Passes over the sample, and more of a small one, until it has made so many steps.
EPOCHS, LEAST_STEPS = 4, 6000
RATE = 0.5
#: Sizes of the short pieces that train and calibrate beside whole texts, and how many calibrate at least.
PIECES, LEAST_PIECES = (20, 60, 200), 2000
SEED = 7
UNKNOWN = "und"
#: Of the calibration rows that are predicted right, at most this share may fall under the threshold.
REJECTED_SHARE = 0.0005
CHUNK_BYTES = 2 << 20
SEGMENT = 1 << 17
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
#: The bytes A to Z become a to z.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _hashes(padded: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram at each byte but the last PAD ones."""
    size = len(padded) - PAD
    h = np.full(size, n * 0x01000193 & 0xFFFFFFFF, np.uint32)
    for i in range(n):
        h = (h ^ padded[i : i + size]) * np.uint32(_MULTIPLIERS[i])
        h ^= h >> np.uint32(15)
    return h & np.uint32(BUCKETS - 1)


def _counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams and the share of each."""
    total = np.zeros(BUCKETS, np.int64)
    for i in range(0, len(text), SEGMENT):
        piece = text[i : i + SEGMENT + PAD]
        piece += bytes(min(SEGMENT, len(text) - i) + PAD - len(piece))
        padded = _LOWER[np.frombuffer(piece, np.uint8)]
        for k in ORDERS:
            total += np.bincount(_hashes(padded, k), minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found, (total[found] / (len(ORDERS) * len(text))).astype(np.float32)


def _few_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The same for a short text."""
    padded = np.concatenate([_LOWER[np.frombuffer(text, np.uint8)], np.zeros(PAD, np.uint8)])
    found, n = np.unique(np.concatenate([_hashes(padded, k) for k in ORDERS]), return_counts=True)
    return found, (n / n.sum()).astype(np.float32)


def _whole(text: bytes | Digest) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(text, Digest):
        return text.found, text.share
    return _counts(text) if len(text) > BUCKETS // 8 else _few_counts(text)


@dataclass
class Digest:
    """What trains of a long text: its counts, and pieces of each of PIECES bytes."""

    found: np.ndarray
    share: np.ndarray
    pieces: list[list[bytes]]

    @staticmethod
    def of(text: bytes, seed: int) -> Digest:
        rng = np.random.default_rng(seed)
        return Digest(*_counts(text), [[_piece(text, size, rng) for _ in range(PIECES_EACH)] for size in PIECES])

    def to_bytes(self) -> bytes:
        head = np.array([len(self.found)], np.int32).tobytes()
        return head + self.found.astype(np.int32).tobytes() + self.share.tobytes() + b"".join(p for of in self.pieces for p in of)

    @staticmethod
    def from_bytes(data: bytes) -> Digest:
        n = int(np.frombuffer(data, np.int32, 1)[0])
        at, pieces = 4 + 8 * n, []
        for size in PIECES:
            pieces.append([data[at + i * size : at + (i + 1) * size] for i in range(PIECES_EACH)])
            at += size * PIECES_EACH
        return Digest(np.frombuffer(data, np.int32, n, 4), np.frombuffer(data, np.float32, n, 4 + 4 * n), pieces)


def _piece(text: bytes | Digest, size: int, rng: np.random.Generator) -> bytes:
    if isinstance(text, Digest):
        of = text.pieces[PIECES.index(size)]
        return of[int(rng.integers(0, len(of)))]
    at = int(rng.integers(0, max(1, len(text) - size + 1)))
    return text[at : at + size]


@dataclass
class Model:
    """scores: each bucket's share of each language's score, by bucket; or, with a head, its embedding,
    whose mean the head turns into scores."""

    langs: list[str]
    scores: np.ndarray
    bias: np.ndarray
    head: np.ndarray | None = None
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, texts: list[bytes | Digest]) -> np.ndarray:
        """A row for each text, which must not be empty."""
        width = self.scores.shape[1]
        total = np.zeros((len(texts), width))
        # Short texts are summed together, long ones in pieces, so that memory is bounded.
        most = max(4096, min(SEGMENT, SEGMENT * 8 // max(1, width)))
        group, held = [], 0
        sizes = np.ones(len(texts), np.int64)
        for i, text in enumerate(texts):
            if isinstance(text, Digest):
                total[i] = len(ORDERS) * (text.share @ self.scores[text.found])
                continue
            sizes[i] = len(text)
            if len(text) > most:
                total[i] = self._long(text, most)
                continue
            if held + len(text) > most:
                total[group] = self._short([texts[k] for k in group])
                group, held = [], 0
            group.append(i)
            held += len(text)
        if group:
            total[group] = self._short([texts[k] for k in group])
        mean = total / (len(ORDERS) * sizes)[:, None]
        z = ((mean if self.head is None else mean @ self.head) + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True, initial=-np.inf))
        return z / z.sum(1, keepdims=True)

    def _short(self, texts: list[bytes]) -> np.ndarray:
        gap = bytes(PAD)
        padded = _LOWER[np.frombuffer(gap.join(texts) + gap, np.uint8)]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate([[0], np.cumsum(sizes + PAD)[:-1]])
        # Cut at each text's start and at its end: every second sum is that of the gap behind it.
        cuts = np.stack([starts, starts + sizes], 1).ravel()[:-1]
        total = np.zeros((len(texts), self.scores.shape[1]))
        for n in ORDERS:
            total += np.add.reduceat(self.scores[_hashes(padded, n)], cuts, axis=0, dtype=np.float64)[::2]
        return total

    def _long(self, text: bytes, most: int) -> np.ndarray:
        total = np.zeros(self.scores.shape[1])
        for i in range(0, len(text), most):
            piece = text[i : i + most + PAD]
            piece += bytes(min(most, len(text) - i) + PAD - len(piece))
            padded = _LOWER[np.frombuffer(piece, np.uint8)]
            for n in ORDERS:
                total += self.scores[_hashes(padded, n)].sum(axis=0, dtype=np.float64)
        return total


def train(texts: list[bytes | Digest], langs: list[str]) -> Model:
    """Fit on texts that are not empty and their languages."""
    names = sorted(set(langs))
    rng = np.random.default_rng(SEED)
    place = {name: i for i, name in enumerate(names)}
    y = np.array([place[x] for x in langs], int)
    fits = rng.random(len(texts)) >= 0.2
    if not fits.any():
        fits[:] = True
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    ids, done = np.flatnonzero(fits), 0
    epochs = max(EPOCHS, -(-LEAST_STEPS // len(ids)))
    for _ in range(epochs):
        for i in rng.permutation(ids):
            rate = RATE * (1 - done / (epochs * len(ids)))
            done += 1
            kind = int(rng.integers(0, len(PIECES) + 1))  # short pieces as well as whole texts
            found, share = _few_counts(_piece(texts[i], PIECES[kind], rng)) if kind < len(PIECES) else _whole(texts[i])
            rows = emb[found]
            mean = share @ rows
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            # A mean of k rows moves each by 1/k only, so their step is scaled up.
            emb[found] = rows - (rate * min(len(found), 200)) * share[:, None] * back
    flat = len(names) <= DIM
    model = Model(names, (emb @ out).astype(np.float32) if flat else emb, bias.astype(np.float64), None if flat else out.astype(np.float64))
    held, y = [t for t, f in zip(texts, fits, strict=True) if not f], y[~fits]
    # So many pieces of each that a small sample's least probability is no chance one.
    times = -(-LEAST_PIECES // max(1, len(held)))
    pieces = [_piece(t, int(rng.choice(PIECES)), rng) for _ in range(times) for t in held]
    return _calibrated(model, held + pieces, np.tile(y, 1 + times))


def _calibrated(model: Model, texts: list[bytes], y: np.ndarray) -> Model:
    """Set the temperature of least log loss, and the threshold of rejection."""
    if not texts or len(model.langs) < 2:
        return model
    logs = np.log(np.concatenate([model.probabilities(texts[i : i + 200]) for i in range(0, len(texts), 200)]) + 1e-30)

    def at(t: float) -> np.ndarray:
        z = np.exp((logs - logs.max(1, keepdims=True)) / t)
        return z / z.sum(1, keepdims=True)

    rows = np.arange(len(y))
    model.temperature = min(np.geomspace(0.1, 10, 41), key=lambda t: -np.log(at(t)[rows, y] + 1e-30).mean())
    p = at(model.temperature)
    right = p.argmax(1) == y
    if right.any():
        model.threshold = float(np.quantile(p.max(1)[right], REJECTED_SHARE))
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document never trains: by the checksum of its id; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = PER_LANG) -> Model:
    """Train on a sample of the labelled rows that are not held out, chosen by a hash of the id."""
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    # One row a label, of which the model has a column each.
    n = {r.l: r.n for r in rows.groupBy(F.col(lang_col).alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    spark = docs.sparkSession
    small_batches(spark)
    each = min(per_lang, max(LEAST_ROWS, MOST_ROWS // len(n)))
    scale = 1 << 40
    shares = [(lang, min(scale, int(scale * each / rows_of))) for lang, rows_of in sorted(n.items())]
    limits = F.broadcast(spark.createDataFrame(shares, "__l string, __most bigint"))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(SEED)), F.lit(scale))
    sample = rows.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"), draw.alias("draw"))
    sample = sample.join(limits, F.col("l") == F.col("__l")).where("draw < __most").select("k", "t", "l").limit(2 * each * len(n))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, CHUNK_BYTES):
            texts = [t.encode() for t in table["t"].to_pylist()]
            made = [t if len(t) <= WHOLE else Digest.of(t, zlib.crc32(t)).to_bytes() for t in texts]
            yield pa.RecordBatch.from_pydict({
                "k": table["k"].combine_chunks(), "l": table["l"].combine_chunks(), "whole": pa.array([len(t) <= WHOLE for t in texts]),
                "t": pa.array(made, pa.binary()),
            })

    found = sample.mapInArrow(digested, "k string, l string, whole boolean, t binary").collect()
    found.sort(key=lambda r: (r.l, r.k or "", r.t))  # one order, whatever the tasks'
    return train([bytes(r.t) if r.whole else Digest.from_bytes(bytes(r.t)) for r in found], [r.l for r in found])


def classify(
    docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "accepted")
) -> DataFrame:
    """docs with the predicted language, its probability and whether it is accepted, under these names;
    the text column must be one of strings."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS rows of DIM columns at most, and DIM numbers a label
    made = list(zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))
    fields = [x for x in docs.schema.fields if x.name not in names]
    others = [x.name for x in fields]
    rows = docs.select(*[F.col(f"`{x}`") for x in others])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for table in chunks(batches, CHUNK_BYTES):
            texts = table[text_col].to_pylist()
            known = [i for i, t in enumerate(texts) if t and m.langs and any(map(str.isalpha, t))]
            lang, score, accepted = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
            p = m.probabilities([texts[i].encode() for i in known])
            for i, best, s in zip(known, p.argmax(1) if known else (), p.max(1) if known else (), strict=True):
                lang[i], score[i], accepted[i] = m.langs[best], float(s), bool(s >= m.threshold)
            out = table.select(others)
            for (name, _), values in zip(made, (lang, score, accepted), strict=True):
                out = out.append_column(name, pa.array(values))
            yield from out.combine_chunks().to_batches()

    return rows.mapInArrow(run, T.StructType([*fields, *[T.StructField(k, v) for k, v in made]]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs)
    found = classify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
