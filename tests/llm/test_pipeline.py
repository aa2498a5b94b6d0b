from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from granary.llm import common, exact_dedup, pii
from granary.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_pii import brute as pii_brute
from tests.test_queries import TABLES, canonical


def test_stages_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "pii", "packing"]
    first = stages["language_id"](spark, docs, sf_dir)
    assert first.columns == docs.columns and first.count() >= 0.99 * docs.count()

    second = stages["exact_dedup"](spark, first, sf_dir).cache()
    by_text = {}
    for r in first.collect():
        by_text[r.text] = max(by_text.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in second.collect()) == sorted(by_text.values())

    third = stages["near_dedup"](spark, second, sf_dir).cache()
    expected = near_brute([(r.doc_id, r.text) for r in second.collect()], 5, 80)
    assert sorted(r.doc_id for r in third.collect()) == sorted(i for i, (_, c) in expected.items() if i == c)

    fourth = stages["pii"](spark, third, sf_dir)
    assert fourth.columns == docs.columns
    before = {r.doc_id: r.text for r in third.collect()}
    for r in fourth.collect():
        assert r.n_chars == len(r.text) and not pii_brute(r.text)
        if not pii_brute(before[r.doc_id]) and "<SECRET>" not in r.text and "<NUMBER>" not in r.text and "<CONTACT>" not in r.text:
            assert r.text == before[r.doc_id]

    last = stages["packing"](spark, fourth, sf_dir)
    assert {r.doc_id for r in last.collect()} == set(before)


def test_run(spark, sf_dir):
    before = common.written()
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert common.written() == before + 1  # only the result is left


def test_a_failed_run_leaves_nothing(spark, sf_dir, monkeypatch):
    before = common.written()

    def fail(spark, docs, sf_dir):
        raise RuntimeError("no")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:2], ("failing", fail)])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, sf_dir)
    assert common.written() == before


def test_a_grown_heap_is_collected(spark, monkeypatch):
    """As a table is written, and only if the driver's heap has grown."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    for share, collected in ((0.0, True), (2.0, False)):
        monkeypatch.setattr(common, "HEAP_SHARE", share, raising=False)
        before = whole()
        assert common.materialise(spark.range(5), "five").count() == 5
        assert (whole() > before) == collected


def test_odd(spark, odd, none):
    for df in (odd, none):
        docs = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "").cache()
            assert docs.columns == df.columns, name
        corpus_pipeline.STAGES[-1][1](spark, docs, "").count()
        assert docs.where("score <> 'mine'").count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got, expected = QUERIES[name](spark, sf_dir).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns) and canonical(got) == canonical(expected)


def test_names():
    assert len({n.split("_")[0] for n in QUERIES}) == 10 and exact_dedup.ORACLE and pii.BASE_KINDS
