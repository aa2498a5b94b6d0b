"""Behaviour of sessions on small tables."""

from __future__ import annotations

import random

import pytest

from granary.errors import AnalysisError
from granary.session import Session


def run(session, sql):
    found = session.execute(sql)
    assert found.kind != "error", found.message
    return found


def values(result):
    return [tuple(r.values()) for r in result.rows]


@pytest.fixture
def school(session):
    inserts = "".join(
        f"INSERT INTO Students VALUES ({i}, 'Est_{i:02d}', {18 + i % 5}); INSERT INTO Grades VALUES ({i}, {i}, {6.0 + i % 5});" for i in range(1, 21)
    )
    result = run(
        session,
        "CREATE TABLE Students (id INTEGER, name VARCHAR(20), age INTEGER);"
        "CREATE TABLE Grades (id INTEGER, id_est INTEGER, grade FLOAT);" + inserts,
    )
    assert "20 row(s) inserted into 'Students'" in result.message
    return session


def test_filters_projection_and_labels(school):
    assert len(run(school, "SELECT * FROM Students WHERE id > 15").rows) == 5
    assert sorted(values(run(school, "SELECT id FROM Students WHERE id BETWEEN 5 AND 10"))) == [(i,) for i in range(5, 11)]
    assert run(school, "SELECT * FROM Students").columns == ["Students.id", "Students.name", "Students.age"]
    one = run(school, "SELECT name FROM Students WHERE id = 1")
    assert one.columns == ["name"] and values(one) == [("Est_01",)]
    assert run(school, "SELECT Students.name, name FROM Students").columns == ["Students.name", "name"]
    nothing = run(school, "SELECT name FROM Students WHERE id > 99")
    assert (nothing.kind, nothing.rows, nothing.columns) == ("table", [], ["name"])


def test_join_group_count(school):
    joined = "SELECT * FROM Students JOIN Grades ON Students.id = Grades.id_est"
    found = run(school, joined)
    assert len(found.rows) == 20 and found.columns[3] == "Grades.id"
    for strategy in ("merge", "hash", "broadcast"):
        assert school.sql_df(joined, strategy).count() == 20
    assert len(run(school, "SELECT id_est, AVG(grade) FROM Grades GROUP BY id_est").rows) == 20
    count = run(school, "SELECT COUNT(id) FROM Students")
    assert count.columns == ["COUNT(id)"] and values(count) == [(20,)]
    grouped = run(school, "SELECT age, COUNT(*) FROM Students JOIN Grades ON Students.id = id_est GROUP BY age ORDER BY age")
    assert values(grouped) == [(a, 4) for a in range(18, 23)]
    own = run(school, "SELECT a.id, b.id FROM Students a JOIN Students b ON a.age = b.age WHERE a.id = 1 ORDER BY b.id")
    assert [r["b.id"] for r in own.rows] == [1, 6, 11, 16]


def test_delete(school):
    assert run(school, "DELETE FROM Students WHERE id = 10").message == "1 row(s) deleted from 'Students'"
    assert len(run(school, "SELECT * FROM Students WHERE id = 10").rows) == 0
    assert len(run(school, "SELECT * FROM Students").rows) == 19
    assert run(school, "DELETE FROM Students WHERE id = 10").message == "0 row(s) deleted from 'Students'"
    # Only rows that match go, even if others share their key.
    run(school, "INSERT INTO Students VALUES (1, 'twin', 99)")
    assert run(school, "DELETE FROM Students WHERE age = 99").message == "1 row(s) deleted from 'Students'"
    assert values(run(school, "SELECT name FROM Students WHERE id = 1")) == [("Est_01",)]
    assert run(school, "DELETE FROM Students").message == "19 row(s) deleted from 'Students'"
    assert run(school, "SELECT COUNT(id), SUM(age), AVG(age), MIN(name) FROM Students").rows[0] == {
        "COUNT(id)": 0, "SUM(age)": 0, "AVG(age)": 0.0, "MIN(name)": None,
    }


def test_names_and_literals(school):
    assert len(run(school, "SELECT id FROM Students WHERE name = Est_03").rows) == 1
    assert len(run(school, "SELECT id FROM Students WHERE id = '3'").rows) == 1
    assert len(run(school, "SELECT id FROM Students WHERE id = 'three'").rows) == 0
    assert len(run(school, "SELECT id FROM Students WHERE id != 'three'").rows) == 20
    assert len(run(school, "SELECT id FROM Grades WHERE id = id_est").rows) == 20
    assert len(run(school, "SELECT g.id FROM Grades g WHERE g.grade >= 10").rows) == 4


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT nothing FROM Students", "SELECT * FROM Nowhere", "SELECT id FROM Students JOIN Grades ON Students.id = id_est", "SELECT x.id FROM Students",
        "SELECT name, COUNT(id) FROM Students", "SELECT * FROM Students GROUP BY id", "SELECT SUM(name) FROM Students", "INSERT INTO Students VALUES (1)",
        "INSERT INTO Students VALUES ('x', 'y', 1)", "INSERT INTO Students VALUES (3000000000, 'y', 1)", "CREATE TABLE D (day DATE)",
        "SELECT * FROM Students WHERE id < 'x'", "SELECT * FROM Students WHERE (id, age) IN (POINT(1, 2), RADIUS 3)", "CREATE TABLE P (id INT, x FLOAT) INDEX (RTREE x)",
        "CREATE TABLE P (id INT) INDEX (BTREE nothing)", "SELECT * FROM Students JOIN Students ON id = id",
    ],
)
def test_errors_are_results(school, sql):
    found = school.execute(sql)
    assert found.kind == "error" and found.message
    assert len(run(school, "SELECT * FROM Students").rows) == 20


def test_create_twice_and_messages(session):
    assert run(session, "CREATE TABLE T (id INT, v FLOAT)").message == "Table 'T' created"
    assert run(session, "CREATE TABLE T (other INT)").message == "Table 'T' already exists"
    assert run(session, "INSERT INTO T VALUES (1, 2)").message == "1 row inserted into 'T'"
    assert run(session, "   ").message == "Empty query"
    found = run(session, "INSERT INTO T VALUES (2, 1.5) SELECT id FROM T WHERE v > 0 DELETE FROM T WHERE id = 2")
    assert sorted(values(found)) == [(1,), (2,)]
    assert session.catalog.list_tables().collect()[0]["name"] == "T"


def test_statements_before_a_failure_stand(session):
    found = session.execute("CREATE TABLE T (id INT); INSERT INTO T VALUES (1); INSERT INTO T VALUES ('x'); INSERT INTO T VALUES (2)")
    assert found.kind == "error"
    assert values(run(session, "SELECT id FROM T")) == [(1,)]
    assert session.execute("SELECT id FROM T; nonsense").kind == "error"


def test_types(session):
    run(session, "CREATE TABLE T (a INT, b BIGINT, c DOUBLE, s STRING(5), d TEXT)")
    run(session, "INSERT INTO T VALUES ('7', 123456789012, 0.1, 'abcdéfghijk', 'x'); INSERT INTO T VALUES (-2.9, 1, 2, 12, '')")
    rows = run(session, "SELECT * FROM T").rows
    assert [r["T.a"] for r in rows] == [7, -2] and rows[0]["T.b"] == 123456789012
    assert rows[0]["T.c"] == pytest.approx(0.1, abs=1e-7) and rows[0]["T.c"] != 0.1  # 32 bits
    assert rows[0]["T.s"] == "abcd" and rows[1]["T.s"] == "12"  # no broken character
    assert len(run(session, "SELECT a FROM T WHERE c = 0.1").rows) == 0


def test_fetch(school):
    found = school.execute("SELECT id FROM Students ORDER BY id", fetch=3)
    assert values(found) == [(1,), (2,), (3,)] and found.more and found.df.count() == 20
    assert not school.execute("SELECT id FROM Students", fetch=20).more


def test_order_by(session):
    run(session, "CREATE TABLE T (id INT, v INT)")
    run(session, "".join(f"INSERT INTO T VALUES ({i}, {100 - i});" for i in range(1, 101)))
    assert values(run(session, "SELECT id FROM T ORDER BY v")) == [(i,) for i in range(100, 0, -1)]
    assert len(session.catalog.table("T").parts) == 1


def test_compaction_and_vacuum(session, monkeypatch):
    from granary.sources import catalog

    monkeypatch.setattr(catalog, "COMPACT_AFTER", 3)
    run(session, "CREATE TABLE T (id INT)")
    for i in range(4):
        run(session, f"INSERT INTO T VALUES ({i})")
    assert len(session.catalog.table("T").parts) == 2
    assert session.catalog.vacuum("T") == 3
    assert sorted(values(run(session, "SELECT id FROM T"))) == [(i,) for i in range(4)]
    assert session.catalog.inspect("T").agg({"rows": "sum"}).first()[0] == 4


def test_versions_isolate_readers(session):
    run(session, "CREATE TABLE T (id INT); INSERT INTO T VALUES (1)")
    before = session.table("T")
    run(session, "DELETE FROM T")
    assert before.count() == 1 and session.table("T").count() == 0


def test_workspaces_are_apart(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    one, two = Session.open(spark, root, "one"), Session.open(spark, root, "two")
    run(one, "CREATE TABLE T (id INT); INSERT INTO T VALUES (1)")
    assert two.execute("SELECT * FROM T").kind == "error"
    again = Session.open(spark, root, "one")
    assert values(run(again, "SELECT id FROM T")) == [(1,)]
    from granary.sources.catalog import Workspaces

    assert Workspaces(spark, root).names() == ["one", "two"]
    with pytest.raises(AnalysisError):
        Workspaces(spark, root).path("../x")


@pytest.mark.parametrize("kind", ["SEQUENTIAL", "BTREE", "HASH"])
def test_layouts(session, kind):
    run(session, f"CREATE TABLE T (id INT, v INT) INDEX ({kind} v)")
    run(session, "".join(f"INSERT INTO T VALUES ({i}, {10 * (i % 20)});" for i in range(1, 41)))
    session.catalog.compact("T")
    run(session, "INSERT INTO T VALUES (41, 50)")
    assert sorted(values(run(session, "SELECT id FROM T WHERE v BETWEEN 50 AND 60"))) == [(5,), (6,), (25,), (26,), (41,)]
    assert sorted(values(run(session, "SELECT id FROM T WHERE v = 50 AND id > 5"))) == [(25,), (41,)]
    assert session.lookup("T", 50).count() == 1 and session.lookup("T", 55).count() == 0
    assert [r.v for r in session.range_search("T", 0, 20).collect()] == [0, 0, 10, 10, 20, 20]
    assert run(session, "DELETE FROM T WHERE v = 50").message == "3 row(s) deleted from 'T'"
    assert len(run(session, "SELECT id FROM T WHERE v = 'x'").rows) == 0


def test_hash_lookup_reads_one_folder(session):
    run(session, "CREATE TABLE T (id INT) INDEX (HASH id)")
    run(session, "".join(f"INSERT INTO T VALUES ({i});" for i in range(200)))
    session.catalog.compact("T")
    hit, all_ = run(session, "SELECT id FROM T WHERE id = 7"), run(session, "SELECT id FROM T")
    assert values(hit) == [(7,)] and 0 < hit.telemetry.files_read < all_.telemetry.files_read
    assert all_.telemetry.rows_scanned == 200 and all_.telemetry.elapsed_ms > 0


@pytest.mark.parametrize("kind", ["SEQUENTIAL", "HASH"])
def test_delete_writes_only_files_with_matches(session, kind):
    run(session, f"CREATE TABLE T (id INT) INDEX ({kind} id)")
    for low in (0, 100, 200):
        run(session, "".join(f"INSERT INTO T VALUES ({i});" for i in range(low, low + 20)))
    before = [p.path for p in session.catalog.table("T").parts]
    assert run(session, "DELETE FROM T WHERE id BETWEEN 105 AND 109").message == "5 row(s) deleted from 'T'"
    parts = session.catalog.table("T").parts
    assert before[0] in [p.path for p in parts] and before[2] in [p.path for p in parts]
    assert sorted(r.id for r in session.table("T").collect()) == [*range(20), *range(100, 105), *range(110, 120), *range(200, 220)]
    again = Session(session.spark, session.catalog.path)
    assert again.table("T").count() == 55 and again.lookup("T", 115).count() == 1
    run(session, "DELETE FROM T WHERE id >= 100; DELETE FROM T WHERE id < 100")
    assert session.table("T").count() == 0 and session.catalog.table("T").parts == []


@pytest.fixture
def grid(session):
    run(session, "CREATE TABLE Pts (id INT, name STRING(8), x FLOAT, y FLOAT) INDEX (RTREE x)")
    run(session, "".join(f"INSERT INTO Pts VALUES ({5 * x + y}, 'p{x}{y}', {x}, {y});" for x in range(5) for y in range(5)))
    return session


def test_radius(grid):
    found = run(grid, "SELECT id FROM Pts WHERE (x, y) IN (POINT(2, 2), RADIUS 1.1)")
    assert found.kind == "spatial" and sorted(values(found)) == [(7,), (11,), (12,), (13,), (17,)]
    assert len(run(grid, "SELECT id FROM Pts WHERE x IN (POINT(2, 2), RADIUS 1)").rows) == 5  # the circle counts
    assert found.spatial["radius"] == 1.1 and found.spatial["results"][0]["distance"] == 0
    assert found.spatial["results"][0]["label"] == "p22" and found.spatial["all_points"].count() == 25
    assert len(run(grid, "SELECT id FROM Pts WHERE (x, y) IN (POINT(1000, 1000), RADIUS 0.5)").rows) == 0
    assert len(run(grid, "SELECT id FROM Pts WHERE id < 12 AND (x, y) IN (POINT(2, 2), RADIUS 1.1)").rows) == 2
    assert len(run(grid, "SELECT id FROM Pts WHERE (x, y) IN (POINT(2, 2), RADIUS 1.1) OR id = 0").rows) == 6
    assert values(run(grid, "SELECT COUNT(id) FROM Pts WHERE (x, y) IN (POINT(2, 2), RADIUS 1.1)")) == [(5,)]
    assert run(grid, "DELETE FROM Pts WHERE (x, y) IN (POINT(0, 0), RADIUS 1)").message == "3 row(s) deleted from 'Pts'"


def test_nearest(grid):
    found = run(grid, "SELECT id FROM Pts WHERE (x, y) IN (POINT(0, 0), K 3)")
    assert values(found) == [(0,), (1,), (5,)]  # ties by id
    assert [r["distance"] for r in found.spatial["results"]] == [0, 1, 1]
    assert values(run(grid, "SELECT id FROM Pts WHERE id > 3 AND (x, y) IN (POINT(0, 0), K 2)")) == [(5,), (6,)]
    for bad in ("(y, x) IN (POINT(0, 0), K 1)", "y IN (POINT(0, 0), K 1)", "(x, y) IN (POINT(0, 0), K 0)", "id = 1 OR (x, y) IN (POINT(0, 0), K 1)"):
        assert grid.execute(f"SELECT id FROM Pts WHERE {bad}").kind == "error", bad


def test_spatial_layout_keeps_rows(grid):
    grid.catalog.compact("Pts")
    assert grid.table("Pts").count() == 25
    assert len(run(grid, "SELECT id FROM Pts WHERE (x, y) IN (POINT(2, 2), RADIUS 1.1)").rows) == 5


def test_condition_trees_lean_left(session):
    """Random chains against a plain evaluator."""
    run(session, "CREATE TABLE T (a INT, b INT, s STRING(4))")
    rows = [(i % 7, i % 5, "xyz"[i % 3]) for i in range(40)]
    run(session, "".join(f"INSERT INTO T VALUES ({a}, {b}, '{s}');" for a, b, s in rows))
    rng = random.Random(3)
    ops = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    for _ in range(8):
        terms = []
        for _ in range(rng.randint(2, 5)):
            i = rng.randrange(3)
            op = rng.choice(list(ops))
            value = rng.choice("xyz") if i == 2 else rng.randint(0, 6)
            terms.append((i, op, value, rng.choice(["AND", "OR"])))
        text = ""
        for i, op, value, glue in terms:
            literal = f"'{value}'" if i == 2 else value
            text += (f" {glue} " if text else "") + f"{'abs'[i]} {op} {literal}"

        def holds(row, terms=terms):
            out = None
            for i, op, value, glue in terms:
                this = ops[op](row[i], value)
                out = this if out is None else (out and this) if glue == "AND" else (out or this)
            return out

        assert sorted(values(run(session, f"SELECT a, b, s FROM T WHERE {text}"))) == sorted(r for r in rows if holds(r)), text


def test_journal(session):
    run(session, "CREATE TABLE T (id INT); INSERT INTO T VALUES (1); DELETE FROM T WHERE id = 1")
    session.execute("INSERT INTO T VALUES ('x')")
    lines = session.journal.lines()
    assert [x["status"] for x in lines if x["operation"] == "DELETE"] == ["BEGIN", "COMMIT"]
    assert lines[-1]["status"] == "ROLLBACK" and lines[-1]["table"] == "T"
    assert all(x["txn"] for x in lines)


def test_sessions_that_write_at_once_lose_nothing(spark, tmp_path):
    """Catalogs without a common lock, as in different processes: every change finds the other's."""
    from granary.sources import catalog

    path = f"file://{tmp_path}/w"
    one, two = Session(spark, path), Session(spark, path)
    run(one, "CREATE TABLE A (id INT)")
    run(two, "CREATE TABLE B (id INT); INSERT INTO A VALUES (1)")
    run(one, "INSERT INTO A VALUES (2); INSERT INTO B VALUES (3)")
    assert two.execute("CREATE TABLE A (id INT)").message == "Table 'A' already exists"
    assert sorted(values(run(two, "SELECT id FROM A"))) == [(1,), (2,)] and values(run(one, "SELECT id FROM B")) == [(3,)]
    # A delete whose files another session has replaced in between begins anew.
    plain = catalog.Catalog._swap
    seen = []

    def late(self, name, old, new):
        if self is one.catalog and not seen:
            seen.append(True)
            two.catalog.compact("A")
        return plain(self, name, old, new)

    catalog.Catalog._swap = late
    try:
        assert run(one, "DELETE FROM A WHERE id = 1").message == "1 row(s) deleted from 'A'"
    finally:
        catalog.Catalog._swap = plain
    assert seen and values(run(two, "SELECT id FROM A")) == [(2,)]
    manifests = one.catalog.files.children(one.catalog.manifests)
    for i in range(catalog.OLD_MANIFESTS + 5):
        run(one, f"INSERT INTO A VALUES ({i})")
    assert len(one.catalog.files.children(one.catalog.manifests)) <= catalog.OLD_MANIFESTS + 1 and manifests


def test_results_come_up_to_a_default(session, monkeypatch):
    from granary import session as module

    run(session, "CREATE TABLE P (id INT, x FLOAT, y FLOAT) INDEX (RTREE x)")
    run(session, "".join(f"INSERT INTO P VALUES ({i}, {i}, 0);" for i in range(9)))
    found = session.execute("SELECT id FROM P WHERE (x, y) IN (POINT(0, 0), RADIUS 99)", fetch=4)
    assert len(found.rows) == 4 and found.more and len(found.spatial["results"]) == 4
    assert module.FETCH == 100_000 and not session.execute("SELECT id FROM P", fetch=None).more


def test_locks_are_shared_by_workspace(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    one, two = Session(spark, path), Session(spark, path + "/")
    with one.locks.writing("t"):
        assert one.locks._locks["t"] is two.locks._locks["t"]
    assert Session(spark, f"file://{tmp_path}/v").locks._locks.get("t") is None
