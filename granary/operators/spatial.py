"""Points in the plane: radius and k-nearest search, and the layout that serves them.

A radius condition carries its bounding box beside the exact distance: the box is a range on each axis,
so it reaches the Parquet scan, where the row groups of a spatial layout (ordered along a Z curve) are
skipped by their minima and maxima. K-nearest is a top-k by distance and key, which needs no full sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.errors import AnalysisError
from granary.operators.scope import Scope, Source, reference
from granary.plans.nodes import Near

GRID_BITS = 10


def distance(x: Column, y: Column, cx: float, cy: float) -> Column:
    """Planar distance of a point from (cx, cy)."""
    x, y = x.cast("double"), y.cast("double")
    return F.sqrt((x - F.lit(cx)) * (x - F.lit(cx)) + (y - F.lit(cy)) * (y - F.lit(cy)))


def within(x: Column, y: Column, cx: float, cy: float, radius: float) -> Column:
    """Whether a point is at most radius away; points on the circle count."""
    # The box is a little wider than the circle, as its bounds are rounded.
    slack = 1e-9 * (abs(cx) + abs(cy) + radius)
    box = x.between(cx - radius - slack, cx + radius + slack) & y.between(cy - radius - slack, cy + radius + slack)
    return box & (distance(x, y, cx, cy) <= F.lit(radius))


def nearest(df: DataFrame, x: Column, y: Column, cx: float, cy: float, k: int, tie: Column) -> DataFrame:
    """The k rows nearest to (cx, cy), nearest first, ties by the tie column; rows without a point
    are never near. Adds no column."""
    if k <= 0:
        raise AnalysisError(f"K must be 1 at least, not {k}")
    found = df.where(x.isNotNull() & y.isNotNull())
    return found.orderBy(distance(x, y, cx, cy).asc(), tie.asc_nulls_last()).limit(k)


def mindist(cx: Column | float, cy: Column | float, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point from a rectangle, 0 inside it."""
    cx, cy = (c if isinstance(c, Column) else F.lit(float(c)) for c in (cx, cy))
    dx = F.greatest(x0 - cx, F.lit(0.0), cx - x1)
    dy = F.greatest(y0 - cy, F.lit(0.0), cy - y1)
    return F.sqrt(dx * dx + dy * dy)


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return (x1 - x0) * (y1 - y0)


def _guessed(source: Source, column: str, names: tuple[str, ...], suffix: str) -> Column:
    for name in (*names, f"{column}_{suffix}"):
        if name in source.columns:
            return reference(source, name)
    raise AnalysisError(f"no {suffix.upper()} column goes with {column!r} in {source.label!r}")


def axes(scope: Scope, near: Near) -> tuple[Column, Column]:
    """The X and Y column of a condition. Two columns must be the table's spatial pair, in order, if it
    has one; a single column must be the pair's X; without a pair it stands for the usual names."""
    sources = [scope.find(c) for c in near.columns]
    source = next((s[0] for s in sources if s), scope.sources[0])
    pair = source.spatial
    if len(near.columns) == 2:
        found = [scope.resolve(c) for c in near.columns]
        if pair and found[0][0] is found[1][0] and (found[0][1], found[1][1]) != pair:
            raise AnalysisError(f"the spatial columns of {source.label!r} are {pair}, not {tuple(c[1] for c in found)}")
        return scope.column(near.columns[0]), scope.column(near.columns[1])
    column = near.columns[0].column
    if pair:
        if column != pair[0]:
            raise AnalysisError(f"the spatial columns of {source.label!r} are {pair}; {column!r} is not the first")
        return reference(source, pair[0]), reference(source, pair[1])
    return _guessed(source, column, ("x", "lon", "longitude"), "x"), _guessed(source, column, ("y", "lat", "latitude"), "y")


def need_pair(scope: Scope, near: Near) -> None:
    """A spatial search, unlike a mere condition among others, needs a table with a spatial layout."""
    if len(scope.sources) == 1 and not scope.sources[0].spatial:
        raise AnalysisError(f"table {scope.sources[0].table!r} has no spatial layout for {', '.join(c.text for c in near.columns)}")


def z_value(x: Column, y: Column, bounds: tuple[float, float, float, float]) -> Column:
    """The place of a point on a Z curve over the bounds (least x, least y, largest x, largest y)."""
    x0, y0, x1, y1 = bounds
    top = (1 << GRID_BITS) - 1

    def cell(c: Column, low: float, high: float) -> Column:
        share = (c.cast("double") - low) / ((high - low) or 1.0)
        return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(top), F.floor(share * top))), F.lit(0)).cast("int")

    cx, cy = cell(x, x0, x1), cell(y, y0, y1)
    out = F.lit(0)
    for b in range(GRID_BITS):
        bit = lambda c: F.shiftright(c, b).bitwiseAND(F.lit(1))  # noqa: B023, E731
        out = out + F.shiftleft(bit(cx), 2 * b) + F.shiftleft(bit(cy), 2 * b + 1)
    return out


def payload(source: Source, near: Near, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(hits, all points) of a spatial search, for display: id, x, y, label, and for hits distance."""
    scope = Scope.of(source)
    x, y = axes(scope, near)
    points = source.df.alias(source.label).select(
        reference(source, key).alias("id"), x.alias("x"), y.alias("y"), reference(source, label).cast("string").alias("label")
    )
    far = points.withColumn("distance", distance(F.col("x"), F.col("y"), near.x, near.y))
    if near.k is not None:
        return nearest(far, F.col("x"), F.col("y"), near.x, near.y, near.k, F.col("id")), points
    return far.where(within(F.col("x"), F.col("y"), near.x, near.y, near.radius or 0.0)), points


def needed(groups: DataFrame, near: Near, x: str, y: str) -> DataFrame:
    """groups: a table's row groups with the least and largest values of its axes (``Catalog.row_groups``). Adds
    the rectangle's area, the distance of the search's centre from it, and whether the search must read it:
    for a radius, if the circle reaches the rectangle; for the nearest k, if no k rows are nearer for sure."""
    box = [F.col(f"low_{x}"), F.col(f"low_{y}"), F.col(f"high_{x}"), F.col(f"high_{y}")]
    far = mindist(near.x, near.y, *box)
    out = groups.withColumn("area", area(*box)).withColumn("mindist", far)
    if near.k is None:
        return out.withColumn("needed", F.coalesce(far <= F.lit(near.radius or 0.0), F.lit(False)))
    corner = F.greatest(*[distance(cx, cy, near.x, near.y) for cx in (box[0], box[2]) for cy in (box[1], box[3])])
    # Rows within each rectangle's farthest corner: the first of these sums to reach k is a sure bound.
    order = Window.orderBy("__corner").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = out.withColumn("__corner", corner).withColumn("__sum", F.sum("rows").over(order))
    bound = sums.where(F.col("__sum") >= near.k).agg(F.min("__corner").alias("__bound"))
    return out.join(F.broadcast(bound)).withColumn("needed", F.coalesce(far <= F.coalesce("__bound", F.lit(float("inf"))), F.lit(False))).drop("__bound")
