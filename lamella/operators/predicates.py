"""Conditions: nested and / or, and subquery tests against other tables."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Condition = Column | str | None

_COMPARE = {
    "eq": operator.eq,
    "neq": operator.ne,
    "gt": operator.gt,
    "gte": operator.ge,
    "lt": operator.lt,
    "lte": operator.le,
}


def as_condition(condition: Condition) -> Column | None:
    """SQL text or a Column; empty conditions become None."""
    if isinstance(condition, str):
        return F.expr(condition) if condition.strip() else None
    return condition


def _fold(conditions, combine) -> Column | None:
    present = [c for c in map(as_condition, conditions) if c is not None]
    return reduce(combine, present) if present else None


def all_true(*conditions: Condition) -> Column | None:
    """AND of the given conditions; each one is a unit of its own, empty ones are skipped."""
    return _fold(conditions, operator.and_)


def any_true(*conditions: Condition) -> Column | None:
    """OR of the given conditions, empty ones are skipped."""
    return _fold(conditions, operator.or_)


def filter_where(df: DataFrame, *conditions: Condition) -> DataFrame:
    condition = all_true(*conditions)
    return df if condition is None else df.where(condition)


def _col(column: Column | str) -> Column:
    return F.expr(column) if isinstance(column, str) else column


def _inner(sub: DataFrame, select: str, where: Condition) -> DataFrame:
    return filter_where(sub, where).select(_col(select).alias("value"))


def is_in(column: Column | str, sub: DataFrame, select: str, where: Condition = None) -> Column:
    """``column IN (SELECT select FROM sub WHERE where)``: planned as a semi join."""
    return _col(column).isin(_inner(sub, select, where))


def not_in(column: Column | str, sub: DataFrame, select: str, where: Condition = None) -> Column:
    """``NOT IN`` with SQL null rules, planned as an anti join on the key.

    True for every row when the list is empty; otherwise only when the value is not null, the
    list holds no null, and the value does not appear. Spark's own NOT IN broadcasts the whole
    list to every task; this form shuffles both sides by the key when they are large.
    """
    values = _inner(sub, select, where)
    column = _col(column)
    counts = values.agg(
        F.struct(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value").isNull()).alias("nulls"))
    ).scalar()
    found = values.where(F.col("value") == column.outer()).exists()
    return ~found & ((counts["rows"] == 0) | ((counts["nulls"] == 0) & column.isNotNull()))


def exists(sub: DataFrame, on: Condition = None) -> Column:
    """``EXISTS``; refer to the outer row in ``on`` with ``outer("name")``."""
    return filter_where(sub, on).exists()


def not_exists(sub: DataFrame, on: Condition = None) -> Column:
    return ~exists(sub, on)


def outer(name: str) -> Column:
    """A column of the outer row, for conditions inside a subquery."""
    return F.col(name).outer()


def compare(column: Column | str, op: str, sub: DataFrame, select: str, where: Condition = None) -> Column:
    """Compare with the single value of a one-row subquery; more than one row is an error."""
    if op not in _COMPARE:
        raise ValueError(f"unknown comparison {op!r}, expected one of {sorted(_COMPARE)}")
    return _COMPARE[op](_col(column), _inner(sub, select, where).scalar())
