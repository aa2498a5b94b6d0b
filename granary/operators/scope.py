"""Names: which column of which table a name in a statement means."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.errors import AnalysisError
from granary.plans.nodes import Name


@dataclass(frozen=True)
class Source:
    """A table as a statement sees it. spatial: its X and Y column, if it has a spatial layout; key:
    the column that its rows are laid out by."""

    table: str
    alias: str | None
    df: DataFrame
    spatial: tuple[str, str] | None = None
    key: str | None = None

    @property
    def label(self) -> str:
        return self.alias or self.table

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.df.schema.fields]


@dataclass(frozen=True)
class Scope:
    sources: tuple[Source, ...]
    types: dict[tuple[str, str], T.DataType] = field(default_factory=dict)

    @staticmethod
    def of(*sources: Source) -> Scope:
        labels = [s.label for s in sources]
        if len(set(labels)) < len(labels):
            raise AnalysisError(f"two tables are called {labels[0]!r}; give them aliases")
        return Scope(sources, {(s.label, f.name): f.dataType for s in sources for f in s.df.schema.fields})

    def find(self, name: Name) -> tuple[Source, str] | None:
        """The source and column of a name, or None if there is none."""
        found = [
            s
            for s in self.sources
            if name.column in s.columns and name.table in (None, s.alias, s.table if s.alias is None or self._alone(s) else None)
        ]
        if len(found) > 1:
            raise AnalysisError(f"column {name.text!r} is ambiguous: it is in {', '.join(s.label for s in found)}")
        return (found[0], name.column) if found else None

    def _alone(self, source: Source) -> bool:
        """An aliased table may still go by its own name if no other source is that table."""
        return sum(s.table == source.table for s in self.sources) == 1

    def resolve(self, name: Name) -> tuple[Source, str]:
        found = self.find(name)
        if found is None:
            raise AnalysisError(f"unknown column {name.text!r}")
        return found

    def column(self, name: Name) -> Column:
        source, column = self.resolve(name)
        return reference(source, column)

    def type_of(self, name: Name) -> T.DataType:
        source, column = self.resolve(name)
        return self.types[source.label, column]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def reference(source: Source, column: str) -> Column:
    return F.col(f"{_quoted(source.label)}.{_quoted(column)}")
