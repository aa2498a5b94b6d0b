from __future__ import annotations

import pytest

from granary.errors import ParseError, ScanError
from granary.plans import nodes as n
from granary.plans.parser import parse
from granary.plans.tokens import tokenize


def kinds(text):
    return [(t.kind, t.text) for t in tokenize(text)[:-1]]


def test_tokens():
    assert kinds("select a1, -2.50 == 'x''y' != \"q\"") == [
        ("word", "select"), ("word", "a1"), ("mark", ","), ("op", "-"), ("float", "2.50"), ("op", "=="),
        ("string", "'x''y'"), ("op", "!="), ("string", '"q"'),
    ]
    assert [t.value for t in tokenize("7 0.5 'it''s' \"a\"\"b\"")[:-1]] == [7, 0.5, "it's", 'a"b']
    assert kinds("<=>=<>") == [("op", "<="), ("op", ">="), ("op", "<"), ("op", ">")]
    assert kinds("ñandú _x") == [("word", "ñandú"), ("word", "_x")]


@pytest.mark.parametrize("text", ["a + b", "a % b", "'open", "#", "a ! b"])
def test_scan_errors(text):
    with pytest.raises(ScanError):
        tokenize(text)


def test_program_separators_may_be_left_out():
    found = parse("SELECT * FROM a SELECT b FROM c;; DELETE FROM d;")
    assert [type(s) for s in found] == [n.Select, n.Select, n.Delete]
    assert parse("") == [] and parse(" ; ") == []


def test_create():
    (c,) = parse("create table T (id INT, name VARCHAR(20), x FLOAT, y FLOAT) index (RTREE x y, HASH id) FROM FILE 'f.csv'")
    assert c.columns[1] == n.ColumnDef("name", "VARCHAR", 20)
    assert c.layouts == (n.LayoutDef("RTREE", "x", "y"), n.LayoutDef("HASH", "id"))
    assert c.path == "f.csv"


def test_select():
    (s,) = parse("SELECT a, t.b, COUNT(*), sum(t.c) FROM t x INNER JOIN u ON x.i = u.j WHERE a = -1 GROUP BY a, t.b ORDER BY a")
    assert s.targets == (n.Name("a"), n.Name("b", "t"), n.Aggregate("COUNT", None), n.Aggregate("SUM", n.Name("c", "t")))
    assert s.alias == "x" and s.join == n.Join("u", None, n.Name("i", "x"), n.Name("j", "u"))
    assert s.where == n.Compare(n.Name("a"), "=", -1)
    assert [t.label for t in s.targets[2:]] == ["COUNT(*)", "SUM(t.c)"]


def test_conditions_lean_to_the_left():
    (s,) = parse("SELECT * FROM t WHERE a = 1 OR b = 2 AND c BETWEEN 3 AND 4 OR d = e")
    w = s.where
    assert (w.op, w.left.op, w.left.left.op) == ("OR", "AND", "OR")
    assert w.left.right == n.Between(n.Name("c"), 3, 4)
    assert w.right.right == n.Name("e")


def test_near():
    (s,) = parse("SELECT * FROM t WHERE (x, t.y) IN (POINT(-1.5, 2), RADIUS 3)")
    assert s.where == n.Near((n.Name("x"), n.Name("y", "t")), -1.5, 2.0, radius=3.0)
    (s,) = parse("SELECT * FROM t WHERE x IN (POINT(0, 0), K 5)")
    assert s.where == n.Near((n.Name("x"),), 0.0, 0.0, k=5)


def test_soft_words_name_columns():
    (s,) = parse("SELECT count, hash FROM radius WHERE point = 1 GROUP BY count, hash")
    assert s.targets == (n.Name("count"), n.Name("hash"))


def test_order_by_directly_after_the_table():
    (s,) = parse("SELECT a FROM t ORDER BY a")
    assert s.alias is None and s.order_by == (n.Name("a"),)
    (s,) = parse("SELECT a FROM t left WHERE left.a = 1")
    assert s.alias == "left"


@pytest.mark.parametrize(
    "text",
    [
        "UPDATE t", "SELECT FROM t", "SELECT * t", "SELECT * FROM t WHERE", "SELECT * FROM t WHERE a", "SELECT * FROM t WHERE a = NULL =",
        "SELECT * FROM a LEFT JOIN b ON a.x = b.x", "SELECT * FROM a FULL OUTER JOIN b ON a.x = b.x", "SELECT * FROM a JOIN b ON a.x < b.x",
        "INSERT INTO t VALUES (a)", "INSERT INTO t VALUES ()", "CREATE TABLE t ()", "CREATE TABLE t (a INT) INDEX (TREE a)",
        "SELECT * FROM t WHERE (a) IN (POINT(1, 2), RADIUS 3)", "SELECT * FROM t WHERE a IN (POINT(1, 2), KNN 3)", "SELECT * FROM t WHERE a IN (1, 2)",
        "SELECT * FROM t WHERE (a = 1)", "SELECT * FROM t WHERE NOT a = 1", "DELETE t", "SELECT SUM(*) FROM t", "INSERT INTO t VALUES (-'a')",
    ],
)
def test_parse_errors(text):
    with pytest.raises(ParseError):
        parse(text)
