"""Grouped and global aggregates.

COUNT counts rows whatever its argument; over no rows SUM is 0, AVG 0.0, MIN and MAX null. All are
built-in functions, so each task aggregates its own rows before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.errors import AnalysisError


def aggregate_of(function: str, argument: Column | None, kind: T.DataType | None) -> Column:
    if function == "COUNT":
        return F.count(F.lit(1))
    if argument is None:
        raise AnalysisError(f"{function} needs a column")
    if function in ("SUM", "AVG") and not isinstance(kind, T.NumericType):
        raise AnalysisError(f"{function} needs a numeric column")
    if function == "SUM":
        return F.coalesce(F.sum(argument), F.lit(0))
    if function == "AVG":
        return F.coalesce(F.avg(argument), F.lit(0.0))
    if function == "MIN":
        return F.min(argument)
    if function == "MAX":
        return F.max(argument)
    raise AnalysisError(f"unknown aggregate {function}")


def aggregate(df: DataFrame, keys: Sequence[Column], aggregates: Sequence[Column]) -> DataFrame:
    """One row per group, or one row in all without keys; without aggregates the distinct keys."""
    if keys and not aggregates:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)
