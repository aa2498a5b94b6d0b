from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from granary.llm import bloom, exact_dedup


def brute(rows):
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        yield i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()


def key(r):
    return repr(r)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r) for r in exact_dedup.annotate(docs, digest_all=True).collect()]
    assert sorted(got) == sorted(brute(rows))
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in brute(rows) if r[3])


def test_odd(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = [tuple(r) for r in exact_dedup.annotate(odd, digest_all=True).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted((r.text or "") for r in kept.collect()) == sorted({t or "" for _, t in rows})
    assert exact_dedup.annotate(none).count() == 0 and exact_dedup.deduplicate(none).count() == 0


def test_same_length_and_prefix(spark):
    """Groups that only the full hash tells apart."""
    start = "p" * 100
    rows = [(i, start + "abc"[i % 3]) for i in range(30)] + [(100, start + "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in exact_dedup.annotate(df, digest_all=True).collect()) == sorted(brute(rows))
    assert sorted(r.doc_id for r in exact_dedup.deduplicate(df).collect()) == [27, 28, 29, 100]


def test_bloom(spark):
    keys = spark.range(500).select(F.xxhash64("id").alias("k"))
    filter_ = bloom.build(keys, "k", 64)
    got = bloom.probe(spark.range(2000).select("id", F.when(F.col("id") < 1990, F.xxhash64("id")).alias("k")), "k", filter_, "hit", 64).collect()
    assert all(r.hit for r in got if r.id < 500)
    assert sum(r.hit for r in got if r.id >= 500) < 100 and not any(r.hit for r in got if r.k is None)
    assert filter_.count() <= 64
    with pytest.raises(ValueError):
        bloom.build(keys, "k", 1 << 20)
