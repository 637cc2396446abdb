"""Joins of points with the intervals that hold them, by hierarchical bins instead of comparing all pairs.

Level k cuts the line into bins of width 2**k. An interval is listed on the level whose bins are about as wide as itself,
so it touches two or three of them; a point looks up its one bin on every level in use. That is an equi-join, which Spark
shuffles, splits where it is skewed, or broadcasts like any other; the exact condition follows. Levels below a
low quantile of the widths (from a sketch) are one, so narrow intervals do not multiply the levels. Intervals
with an infinite end are listed on a level of their own, with a single bin.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The quantile of widths below which intervals share a level.
LOW = 0.25
#: The level of intervals without a finite width, and the bound of bin numbers.
ENDLESS, FARTHEST = 5000, 2.0**62


@dataclass(frozen=True)
class Between:
    """``point BETWEEN low AND high``, as SQL over qualified columns; both ends belong to the interval.

    The point is a column of one side of the join, the ends are columns of the other.
    """

    point: str
    low: str
    high: str

    def condition(self) -> Column:
        return F.expr(self.point).between(F.expr(self.low), F.expr(self.high))


def _has(df: DataFrame, expr: str) -> bool:
    try:
        df.select(F.expr(expr))
    except AnalysisException:
        return False
    return True


def _number(df: DataFrame, expr: str) -> Column:
    """A value as a double that keeps the order: a number, or the seconds of a time."""
    kind, value = df.select(F.expr(expr)).schema[0].dataType, F.expr(expr)
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return value.cast("timestamp").cast("double")
    raise ValueError(f"intervals need numbers or times, not {kind.simpleString()}: {expr}")


def _bin(value: Column, level: Column) -> Column:
    far = F.least(F.greatest(value / F.pow(F.lit(2.0), level), F.lit(-FARTHEST)), F.lit(FARTHEST))
    return F.when(level == ENDLESS, F.lit(0)).otherwise(F.floor(far))


def _leveled(intervals: DataFrame, between: Between, names: tuple[str, str, str]) -> tuple[DataFrame, Column]:
    """The intervals that hold any point, with their ends as numbers and their level; and the levels in use.

    Both are subqueries over the two columns of the ends: nothing runs now.
    """
    level, low, high = names
    ends = {low: _number(intervals, between.low), high: _number(intervals, between.high)}
    held = intervals.withColumns(ends).where(F.expr(between.low) <= F.expr(between.high))
    width = F.col(high) - F.col(low)
    finite = (F.abs(F.col(low)) < float("inf")) & (F.abs(F.col(high)) < float("inf")) & (width < float("inf"))
    own = F.when(finite & (width > 0), F.ceil(F.log2(width)).cast("int"))
    lowest = held.select(own.alias("own")).agg(F.percentile_approx("own", LOW).alias("lowest")).scalar()
    lowest = F.coalesce(lowest, F.lit(0))
    held = held.withColumn(level, F.when(finite, F.greatest(F.coalesce(own, lowest), lowest)).otherwise(F.lit(ENDLESS)))
    levels = held.agg(F.collect_set(level)).scalar()  # at most one for each power of two
    return held, levels


def interval_join(left: DataFrame, right: DataFrame, between: Between, on: Column | None = None) -> DataFrame:
    """The inner join of both sides where the point of one lies within the interval of the other."""
    points, intervals = (left, right) if _has(left, between.point) else (right, left)
    if not (_has(points, between.point) and _has(intervals, between.low) and _has(intervals, between.high)):
        raise ValueError("the point must be a column of one side, the ends of its interval columns of the other")
    names = ("interval level", "interval low", "interval high")
    held, levels = _leveled(intervals, between, names)
    level, low, high = (F.col(n) for n in names)
    bins = F.sequence(_bin(low, level), _bin(high, level))
    listed = held.withColumn("interval bin", F.explode(bins)).drop("interval low", "interval high")
    asked = points.withColumn("point levels", levels).withColumn("point value", _number(points, between.point))
    asked = asked.withColumn("point level", F.explode("point levels"))
    asked = asked.withColumn("point bin", _bin(F.col("point value"), F.col("point level")))
    asked = asked.drop("point levels", "point value")
    meet = [F.col("point level") == level, F.col("point bin") == F.col("interval bin"), between.condition()]
    same = reduce(lambda a, b: a & b, meet if on is None else [*meet, on])
    sides = (asked, listed) if points is left else (listed, asked)
    joined = sides[0].join(sides[1], same)
    return joined.drop("point level", "point bin", "interval level", "interval bin")
