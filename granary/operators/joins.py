"""Joins. The optimizer picks the strategy; one may be asked for.

A broadcast is only ever asked for if the estimated size of that side is under a limit; beyond it the
join shuffles both sides. Sort-merge joins spill and split skewed partitions, so they are what stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.errors import AnalysisError

BROADCAST_LIMIT = 64 << 20
STRATEGIES = ("auto", "merge", "hash", "broadcast")


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a DataFrame's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def equi_join(left: DataFrame, right: DataFrame, on: Column, strategy: str = "auto") -> DataFrame:
    """Inner join on an equality. merge: sort both sides; hash: build a table from the left side's
    partitions; broadcast: send the smaller side everywhere if it is small enough."""
    if strategy not in STRATEGIES:
        raise AnalysisError(f"a join strategy is one of {', '.join(STRATEGIES)}, not {strategy!r}")
    if strategy == "merge":
        return left.join(right.hint("merge"), on, "inner")
    if strategy == "hash":
        return left.hint("shuffle_hash").join(right, on, "inner")
    if strategy == "broadcast":
        sizes = estimated_bytes(left), estimated_bytes(right)
        if min(sizes) <= BROADCAST_LIMIT:
            if sizes[0] < sizes[1]:
                return F.broadcast(left).join(right, on, "inner")
            return left.join(F.broadcast(right), on, "inner")
    return left.join(right, on, "inner")


def theta_join(left: DataFrame, right: DataFrame, condition: Column, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Inner join on any condition. Without an equality every pair must be looked at: a side under the limit
    is sent to the tasks of the other; of two larger ones, every partition meets every partition, each
    pair of them in a task of its own that reads one side as a stream."""
    sizes = estimated_bytes(left), estimated_bytes(right)
    if min(sizes) > limit:
        return left.hint("shuffle_replicate_nl").join(right, condition, "inner")
    if sizes[0] < sizes[1]:
        return F.broadcast(left).join(right, condition, "inner")
    return left.join(F.broadcast(right), condition, "inner")
