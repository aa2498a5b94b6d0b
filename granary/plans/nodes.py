"""Statements and expressions of the dialect, as the parser makes them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Name:
    """A column, perhaps qualified; text is as typed."""

    column: str
    table: str | None = None

    @property
    def text(self) -> str:
        return f"{self.table}.{self.column}" if self.table else self.column


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Aggregate:
    """argument is None for COUNT(*)."""

    function: str
    argument: Name | None

    @property
    def label(self) -> str:
        return f"{self.function}({self.argument.text if self.argument else '*'})"


@dataclass(frozen=True)
class Compare:
    left: Name
    op: str
    right: object  # a number, a string, or a Name


@dataclass(frozen=True)
class Between:
    column: Name
    low: object
    high: object


@dataclass(frozen=True)
class Near:
    """Points within radius of (x, y), or the k nearest to it."""

    columns: tuple[Name, ...]
    x: float
    y: float
    radius: float | None = None
    k: int | None = None


@dataclass(frozen=True)
class Both:
    """AND or OR; chains lean to the left, with equal precedence."""

    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Join:
    table: str
    alias: str | None
    left: Name
    right: Name


@dataclass(frozen=True)
class Select:
    targets: tuple[Star | Name | Aggregate, ...]
    table: str
    alias: str | None = None
    join: Join | None = None
    where: object = None
    group_by: tuple[Name, ...] = ()
    order_by: tuple[Name, ...] = ()


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    size: int | None = None


@dataclass(frozen=True)
class LayoutDef:
    kind: str
    column: str
    second: str | None = None


@dataclass(frozen=True)
class Create:
    table: str
    columns: tuple[ColumnDef, ...]
    layouts: tuple[LayoutDef, ...] = ()
    path: str | None = None


@dataclass(frozen=True)
class Insert:
    table: str
    values: tuple[object, ...] = field(default=())


@dataclass(frozen=True)
class Delete:
    table: str
    where: object = None


Statement = Select | Create | Insert | Delete
