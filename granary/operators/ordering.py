"""Sorting: ascending, nulls last. Spark's sort spills to disk and merges, whatever the size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.services import sort_metrics
from granary.sources.files import shared_root


def ascending(df: DataFrame, *columns: Column | str) -> DataFrame:
    return df.orderBy(*[(F.col(c) if isinstance(c, str) else c).asc_nulls_last() for c in columns])


def top(df: DataFrame, n: int, *columns: Column | str) -> DataFrame:
    """The first n rows in ascending order, without sorting the rest."""
    return ascending(df, *columns).limit(n)


def sorted_with_stats(df: DataFrame, *columns: Column | str) -> tuple[DataFrame, dict[str, int]]:
    """df sorted into files of the checkpoint folder, and what that took: rows, runs, bytes written and
    spilled, and peak memory."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    plan = ascending(df, *columns)
    return plan.checkpoint(), sort_metrics(plan)
