"""A SELECT statement becomes a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.errors import AnalysisError
from granary.operators import aggregates, joins, ordering, predicates, spatial
from granary.operators.scope import Scope, Source, reference
from granary.plans.nodes import Aggregate, Name, Near, Select, Star


def _joined(select: Select, sources: tuple[Source, ...], scope: Scope, strategy: str) -> DataFrame:
    frames = [s.df.alias(s.label) for s in sources]
    if select.join is None:
        return frames[0]
    one, two = scope.resolve(select.join.left), scope.resolve(select.join.right)
    if one[0] is two[0]:
        raise AnalysisError("a join condition must name a column of each table")
    return joins.equi_join(frames[0], frames[1], reference(*one) == reference(*two), strategy)


def _named(columns: list[tuple[Column, str]]) -> list[Column]:
    """Columns under their labels; of equal labels the first stays."""
    seen: dict[str, Column] = {}
    for column, label in columns:
        seen.setdefault(label, column.alias(label))
    return list(seen.values())


def _star(sources: tuple[Source, ...], joined: bool) -> list[tuple[Column, str]]:
    return [(reference(s, c), f"{s.label if joined else s.table}.{c}") for s in sources for c in s.columns]


def lower_select(select: Select, sources: tuple[Source, ...], strategy: str = "auto") -> DataFrame:
    """sources: the statement's tables, in its order."""
    scope = Scope.of(*sources)
    df = _joined(select, sources, scope, strategy)
    rest, near = predicates.nearest_apart(select.where)
    if near is not None or isinstance(select.where, Near):
        spatial.need_pair(scope, near or select.where)
    if rest is not None:
        df = df.where(predicates.condition(scope, rest))
    ordered: list[Column] = []
    if near is not None:
        x, y = spatial.axes(scope, near)
        source = scope.find(near.columns[0]) or (sources[0], "")
        df = spatial.nearest(df, x, y, near.x, near.y, near.k or 0, reference(source[0], source[0].columns[0]))
        ordered = [spatial.distance(x, y, near.x, near.y)]

    grouped = [t for t in select.targets if isinstance(t, Aggregate)]
    if grouped or select.group_by:
        return _grouped(select, scope, df)
    if select.order_by:
        ordered = [scope.column(c) for c in select.order_by]
    if ordered:
        df = ordering.ascending(df, *ordered)
    columns: list[tuple[Column, str]] = []
    for target in select.targets:
        columns += _star(sources, select.join is not None) if isinstance(target, Star) else [(scope.column(target), target.text)]
    return df.select(*_named(columns))


def _grouped(select: Select, scope: Scope, df: DataFrame) -> DataFrame:
    keys = {scope.resolve(c)[0].label + "\0" + c.column: f"__key{i}" for i, c in enumerate(select.group_by)}
    made: dict[str, Column] = {}
    columns: list[tuple[Column, str]] = []

    def key_of(name: Name) -> str:
        source, column = scope.resolve(name)
        found = keys.get(source.label + "\0" + column)
        if found is None:
            raise AnalysisError(f"{name.text!r} is neither grouped nor aggregated")
        return found

    for target in select.targets:
        if isinstance(target, Star):
            raise AnalysisError("* does not go with GROUP BY or aggregates")
        if isinstance(target, Aggregate):
            argument = target.argument
            kind = scope.type_of(argument) if argument else None
            column = scope.column(argument) if argument else None
            name = f"__agg{len(made)}"
            made[name] = aggregates.aggregate_of(target.function, column, kind).alias(name)
            columns.append((F.col(name), target.label))
        else:
            columns.append((F.col(key_of(target)), target.text))
    key_columns = [scope.column(c).alias(f"__key{i}") for i, c in enumerate(select.group_by)]
    df = aggregates.aggregate(df, key_columns, list(made.values()))
    if select.order_by:
        df = ordering.ascending(df, *[key_of(c) for c in select.order_by])
    return df.select(*_named(columns))
