"""Conditions as Column expressions.

Everything becomes one expression tree that leans to the left, as the dialect's AND and OR do, so the
optimizer can push any conjunct to the scan. Literals are typed while the plan is built: a string
beside a numeric column is read as that column's kind of number, and one that is no number is unequal
to every value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.errors import AnalysisError
from granary.operators import spatial
from granary.operators.scope import Scope
from granary.plans.nodes import Between, Both, Compare, Name, Near

_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def _is_text(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.CharType, T.VarcharType))


def _literal(value: object, kind: T.DataType) -> Column | None:
    """value beside a column of this type, or None if the two can never be equal."""
    if isinstance(kind, T.NumericType):
        if not isinstance(value, str):
            return F.lit(value)
        try:
            return F.lit(int(value) if isinstance(kind, T.IntegralType) else float(value))
        except ValueError:
            return None
    if _is_text(kind):
        return F.lit(value) if isinstance(value, str) else None
    return F.lit(value).cast(kind)


def compare(scope: Scope, c: Compare) -> Column:
    left, kind = scope.column(c.left), scope.type_of(c.left)
    right: Column | None
    if isinstance(c.right, Name) and scope.find(c.right):
        right, other = scope.column(c.right), scope.type_of(c.right)
        if isinstance(kind, T.NumericType) and _is_text(other) or isinstance(other, T.NumericType) and _is_text(kind):
            right = None
    else:
        # A name that is no column stands for a string, itself.
        right = _literal(c.right.text if isinstance(c.right, Name) else c.right, kind)
    if right is not None:
        return _OPS[c.op](left, right)
    if c.op in ("=", "!="):
        return F.lit(c.op == "!=") & left.isNotNull()
    raise AnalysisError(f"cannot order {c.left.text!r} against {c.right!r}")


def condition(scope: Scope, node: object) -> Column:
    """The expression of a condition without k-nearest terms."""
    if isinstance(node, Both):
        left, right = condition(scope, node.left), condition(scope, node.right)
        return left & right if node.op == "AND" else left | right
    if isinstance(node, Between):
        return compare(scope, Compare(node.column, ">=", node.low)) & compare(scope, Compare(node.column, "<=", node.high))
    if isinstance(node, Compare):
        return compare(scope, node)
    if isinstance(node, Near):
        if node.k is not None:
            raise AnalysisError("a k-nearest condition must stand alone or be joined to others by AND only")
        x, y = spatial.axes(scope, node)
        return spatial.within(x, y, node.x, node.y, node.radius or 0.0)
    raise AnalysisError(f"no condition: {node!r}")


def nearest_apart(node: object) -> tuple[object, Near | None]:
    """A condition's k-nearest term, if it has one among its top conjuncts, and the rest."""
    if isinstance(node, Near) and node.k is not None:
        return None, node
    if isinstance(node, Both) and node.op == "AND":
        rest, near = nearest_apart(node.left)
        if near is None:
            right, near = nearest_apart(node.right)
            return (Both("AND", rest, right) if right is not None else rest), near
        return (Both("AND", rest, node.right) if rest is not None else node.right), near
    return node, None


def equals(node: object, column: str) -> object | None:
    """The literal that a top conjunct sets column equal to, or None."""
    if isinstance(node, Compare) and node.op == "=" and node.left.column == column and not isinstance(node.right, Name):
        return node.right
    if isinstance(node, Both) and node.op == "AND":
        found = equals(node.left, column)
        return found if found is not None else equals(node.right, column)
    return None
