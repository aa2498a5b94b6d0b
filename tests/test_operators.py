from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from granary.errors import AnalysisError
from granary.functions.types import Field, cut_bytes, field_of_samples
from granary.operators import joins, ordering, spatial
from granary.services import DeadlockError, Journal, SharedLock, TableLocks, WaitGraph, summary
from granary.session import Session


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def frame(spark, name, *values):
    """A relation of known size, unlike one made from Python rows."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(f'({v})' for v in values)} AS t({name})")


def test_join_results_and_strategies(spark):
    left, right = frame(spark, "k", 1, 1, 2), frame(spark, "j", 1, 2, 2)
    on = F.col("k") == F.col("j")
    nodes = {"merge": "SortMergeJoin", "hash": "ShuffledHashJoin", "broadcast": "BroadcastHashJoin"}
    for strategy, node in nodes.items():
        df = joins.equi_join(left, right, on, strategy)
        assert df.count() == 4 and node in plan(df)
    with pytest.raises(AnalysisError):
        joins.equi_join(left, right, on, "magic")
    five = frame(spark, "k", 1, 2, 3, 4, 5)
    assert sorted(r.k for r in joins.equi_join(five, frame(spark, "j", 3, 5, 7), on, "hash").collect()) == [3, 5]


def test_broadcast_only_if_small(spark, monkeypatch):
    left, right = frame(spark, "k", 1, 2), frame(spark, "j", 1, 2)
    monkeypatch.setattr(joins, "BROADCAST_LIMIT", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # what the optimizer would do by itself
    try:
        assert "Broadcast" not in plan(joins.equi_join(left, right, F.col("k") == F.col("j"), "broadcast"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_theta_join(spark):
    left, right = frame(spark, "k", 1, 2, 3), frame(spark, "j", 2, 3, 4)
    assert sorted(r.k for r in joins.theta_join(left, right, F.col("k") == F.col("j")).collect()) == [2, 3]
    assert joins.theta_join(left, right, F.col("k") < F.col("j")).count() == 6
    # Two sides beyond the limit: their partitions meet in tasks of their own.
    large = joins.theta_join(left, right, F.col("k") < F.col("j"), limit=1)
    assert large.count() == 6 and "CartesianProduct" in plan(large) and "BroadcastNestedLoop" not in plan(large)


def test_sorting(spark):
    df = spark.createDataFrame([(100 - i,) for i in range(100)] + [(None,)], "id int").repartition(5)
    assert [r.id for r in ordering.ascending(df, "id").collect()] == [*range(1, 101), None]
    assert "TakeOrderedAndProject" in plan(ordering.top(df, 3, "id"))


def test_pushdown(spark, sf_dir):
    s = Session.over(spark, sf_dir)
    p = plan(s.sql_df("SELECT l_orderkey FROM lineitem WHERE l_quantity BETWEEN 5 AND 6"))
    assert "GreaterThanOrEqual(l_quantity" in p and "LessThanOrEqual(l_quantity" in p
    assert "l_comment" not in p and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p
    p = plan(s.sql_df("SELECT c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000 AND o_totalprice > 5"))
    assert "GreaterThan(c_acctbal,9000" in p and "GreaterThan(o_totalprice,5" in p
    df = s.table("customer").alias("customer")
    near = spatial.nearest(df, F.col("c_nationkey"), F.col("c_acctbal"), 1, 2, 3, F.col("c_custkey"))
    assert "TakeOrderedAndProject" in plan(near)
    box = df.where(spatial.within(F.col("c_acctbal"), F.col("c_acctbal"), 1.0, 2.0, 3.0))
    assert "GreaterThanOrEqual(c_acctbal" in plan(box)


def test_rectangles(spark):
    one = spark.range(1).select(*[F.lit(v).cast("double").alias(k) for k, v in (("x0", 0), ("y0", 0), ("x1", 2), ("y1", 3))])
    args = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    got = one.select(spatial.mindist(1, 1, *args), spatial.mindist(5, 7, *args), spatial.mindist(-1, 1, *args), spatial.area(*args)).first()
    assert tuple(got) == (0, 5, 1, 6)


def test_cut_bytes(spark):
    df = spark.createDataFrame([("abéf", 4), ("abéf", 3), ("😀😀", 5), ("", 3), (None, 3), ("abc", 3)], "s string, n int")
    got = [df.where(F.lit(True)).select(cut_bytes(F.col("s"), n)).collect()[i][0] for i, n in enumerate((4, 3, 5, 3, 3, 3))]
    assert got == ["abé", "ab", "😀", "", None, "abc"]


def test_inference(spark):
    def inferred(name, samples, longest):
        rows = [(v, True) for v in samples] + [("z" * longest, False)]
        found = spark.createDataFrame(rows, "v string, typed boolean").agg(field_of_samples(F.col("v"), F.col("typed")).alias("f")).first().f
        return Field(name, found.type, found.size)

    assert inferred("a", ["1", "-2"], 2).type == "INTEGER"
    assert inferred("a", ["1", "3000000000"], 9).type == "BIGINT"
    assert inferred("a", ["3000000000", "1.5"], 9).type == "FLOAT"
    assert (inferred("a", ["1", "x"], 30).type, inferred("a", ["x"], 30).size, inferred("a", ["x"], 3).size, inferred("a", ["x"], 500).size) == ("STRING", 34, 20, 120)
    assert inferred("a", [], 0).type == "INTEGER"


def test_summary():
    assert summary([]) == "OK"
    assert summary([("insert", "t", 1)]) == "1 row inserted into 't'"
    assert summary([("create", "Table 'u' created", 0), ("insert", "t", 1), ("insert", "t", 1), ("delete", "u", 2), ("delete", "u", 3)]) == (
        "2 row(s) inserted into 't'\n5 row(s) deleted from 'u'\nTable 'u' created"
    )


def test_table_lock_journals_waits(tmp_path):
    locks = TableLocks(Journal(str(tmp_path / "j")))
    entered = threading.Event()

    def hold():
        with locks.writing("t", "one"):
            entered.set()
            time.sleep(0.2)

    thread = threading.Thread(target=hold)
    thread.start()
    entered.wait()
    with locks.writing("t", "two"):
        pass
    thread.join()
    assert [x["status"] for x in locks.journal.lines()] == ["WAITING", "RESUMED"]


def test_wait_graph():
    g = WaitGraph()
    g.wait(1, {2})
    g.wait(2, {3})
    with pytest.raises(DeadlockError):
        g.wait(3, {1})
    g.done(1)
    g.wait(3, {1})


def test_shared_lock():
    lock = SharedLock(timeout=0.2)
    seen = []

    def read():
        with lock.reading():
            seen.append("read")

    with lock.reading(), lock.reading():
        t = threading.Thread(target=read)
        t.start()
        t.join()
    assert seen == ["read"]
    failed = []

    def write():
        try:
            with lock.writing():
                seen.append("write")
        except DeadlockError:
            failed.append(True)

    with lock.reading():
        t = threading.Thread(target=write)
        t.start()
        t.join()
    assert failed == [True]
    with lock.writing(), lock.writing(), lock.reading():
        pass
    write()
    assert seen[-1] == "write"


def test_row_groups_that_a_search_needs(spark):
    """Rectangles of random points: no hit of a radius or of the nearest k lies in one that is left out."""
    import math
    import random

    from granary.plans.nodes import Name, Near

    rng = random.Random(5)
    groups, points = [], []
    for g in range(40):
        x, y = rng.uniform(-50, 50), rng.uniform(-50, 50)
        own = [(x + rng.uniform(0, 9), y + rng.uniform(0, 9)) for _ in range(rng.randint(1, 20))]
        points += [(g, *p) for p in own]
        xs, ys = zip(*own, strict=True)
        groups.append((f"f{g}", 0, len(own), min(xs), max(xs), min(ys), max(ys)))
    df = spark.createDataFrame(groups, "file string, row_group int, rows bigint, low_x double, high_x double, low_y double, high_y double")
    for _ in range(4):
        cx, cy = rng.uniform(-60, 60), rng.uniform(-60, 60)
        far = sorted((math.dist((cx, cy), p[1:]), p[0]) for p in points)
        for near, hits in (
            (Near((Name("x"), Name("y")), cx, cy, radius=15.0), {g for d, g in far if d <= 15}),
            (Near((Name("x"), Name("y")), cx, cy, k=12), {g for _, g in far[:12]}),
            (Near((Name("x"), Name("y")), cx, cy, k=10**6), {g for _, g in far}),
        ):
            found = spatial.needed(df, near, "x", "y").collect()
            needed = {int(r.file[1:]) for r in found if r.needed}
            assert len(found) == 40 and hits <= needed and (near.k == 10**6 or len(needed) < 40)
            assert all(abs(r.area - (r.high_x - r.low_x) * (r.high_y - r.low_y)) < 1e-9 for r in found)
