from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from granary.llm import fingerprint as fp


@pytest.fixture(scope="module")
def ranks(spark, sf_dir):
    return fp.fit_ranks(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_features(text: bytes, ranks) -> list[int]:
    """Positions of the features, step by step."""
    n = len(text) - fp.WINDOW + 1
    rank = []
    for i in range(max(0, n)):
        counts = Counter(text[i : i + fp.WINDOW]).values()
        total = sum(round(c * math.log2(c) * (1 << 20)) for c in counts)
        top = 6 * fp.WINDOW << 20
        rank.append(int(ranks[(top - total) * (fp.CLASSES - 1) // top]))
    points = [0] * len(rank)
    for i in range(len(rank)):
        if rank[i] < int(fp._NONE):
            run = rank[i : i + fp.WINDOW]
            points[i + run.index(min(run))] += 1
    least = min(max(n // 8, 1), fp.POINTS)
    return [i for i in range(len(rank)) if points[i] >= least and rank[i] < int(fp._NONE)]


@pytest.mark.parametrize("segment", [1 << 18, 300])
def test_features_by_brute_force(ranks, monkeypatch, segment):
    monkeypatch.setattr(fp, "SEGMENT", segment)
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, rng.integers(1, 9)).astype(np.uint8)) for _ in range(80)]
    texts = [b" ".join(words[i] for i in rng.integers(0, 80, n)) for n in (0, 3, 12, 15, 30, 200, 400)] + [b"a" * 500]
    corpus = fp.Corpus(texts)
    of, hashes = corpus.features(ranks)
    assert list(of) == [k for k, t in enumerate(texts) for _ in brute_features(t, ranks)]
    for k, t in enumerate(texts):
        alone = fp.Corpus([t]).features(ranks)[1]
        assert list(hashes[of == k]) == list(alone)


def test_likeness(ranks):
    rng = np.random.default_rng(6)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(2000)]
    text = lambda n: b" ".join(words[i] for i in rng.integers(0, 2000, n))
    long, other = text(6000), text(6000)
    half = long[: len(long) // 2] + other[: len(long) // 2]
    a, b, c, d, empty = fp.digests([long, other, half, long, b""], ranks)
    assert len(a) > 1 and fp.likeness(a, d) == 1.0
    assert fp.likeness(a, b) < 0.1 < 0.3 < fp.likeness(a, c) < 0.9
    assert fp.likeness(empty, empty) == 1.0 and fp.likeness(a, empty) == 0.0
    assert fp.encode(a) == fp.encode(d) != fp.encode(b)


def expected_edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    for (key, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        yield key, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()


def test_edited_texts(spark, sf_dir, ranks):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = fp.compare_with_next(docs.repartition(3), ranks).collect()
    rows = [tuple(r) for r in docs.collect()]
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(expected_edits(rows))
    by_text: dict[str, set] = {}
    texts = dict(rows)
    for r in got:
        by_text.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in by_text.values())
    assert np.mean([r.near_edited for r in got]) > 0.3 > 0.05 > np.mean([r.near_next for r in got])


def test_odd(spark, odd, none, ranks):
    got = fp.compare_with_next(odd, ranks).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(expected_edits([(r.doc_id, r.text) for r in odd.collect()]), key=key)
    assert fp.compare_with_next(none, ranks).count() == 0 and fp.fingerprint(none, ranks).count() == 0
    assert len(fp.fit_ranks(none)) == fp.CLASSES
    one = fp.compare_with_next(odd.where("doc_id = 7"), ranks).first()
    assert one.near_next == 1.0
    assert fp.fingerprint(odd, ranks).where("id = 'mine' and fingerprint is not null").count() == odd.count()


def filters(coded: str) -> list[set[int]]:
    """The bits set in each filter of a written fingerprint."""
    n, data = coded.split(":")
    data = base64.b64decode(data)
    size = fp.FILTER_BITS // 8
    assert len(data) == int(n) * size
    return [{i for i in range(fp.FILTER_BITS) if data[k * size + i // 8] >> (7 - i % 8) & 1} for k in range(int(n))]


def plain_likeness(a: list[set[int]], b: list[set[int]]) -> float:
    """Filter by filter: shared bits above chance over the most that could be shared."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0

    def one_way(xs, ys):
        best = []
        for x in xs:
            each = []
            for y in ys:
                most, chance = min(len(x), len(y)), len(x) * len(y) / fp.FILTER_BITS
                floor = chance + fp.CUTOFF * (most - chance)
                each.append(min(1, max(0, (len(x & y) - floor) / max(most - floor, 1e-9))))
            best.append(max(each))
        return sum(best) / len(best)

    if len(a) == len(b):
        return (one_way(a, b) + one_way(b, a)) / 2
    return one_way(a, b) if len(a) < len(b) else one_way(b, a)


def test_likeness_and_filters_by_brute_force(spark, sf_dir, ranks):
    """What the query returns, from its texts: the filters by features one after the other, the likeness by sets of bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 4000").select("doc_id", "text").limit(60)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: -r[0])
    got = {r.doc_id: r for r in fp.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string"), ranks).collect()}

    def built(text: bytes) -> list[set[int]]:
        hashes = [int(h) for h in fp.Corpus([text])._hashes(np.array(brute_features(text, ranks), int))]
        if not hashes and text:
            hashes = [int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")]
        out = [set() for _ in range(-(-len(hashes) // fp.PER_FILTER))]
        for i, h in enumerate(hashes):
            for k in range(fp.PROBES):
                bit = (h >> (11 * k)) % fp.FILTER_BITS
                out[i // fp.PER_FILTER].add(bit)
        return out

    assert len(rows) > 30
    for (key, text), (after, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        r = got[key]
        half = len(text) // 2
        own, edited = filters(r.fingerprint), filters(r.edited_fingerprint)
        assert own == built(text.encode()) and edited == built((text[: len(text) - half] + following[:half]).encode())
        assert abs(r.near_edited - plain_likeness(own, edited)) < 1e-9
        assert abs(r.near_next - plain_likeness(own, filters(got[after].fingerprint))) < 1e-9
