"""Projection, implicit grouping, ordering and limits: from resolved outputs to a result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.names import DIM, FCT
from lamella.operators.aggregate import agg_column, suffix_agg
from lamella.operators.dates import column_type
from lamella.operators.predicates import Condition, as_condition
from lamella.operators.roles import canonical_order, ident
from lamella.operators.select import Output, as_column, put

GROUP_DIMS = "dims"


def group_keys(group_by) -> tuple[list[Column | str], bool]:
    """Explicit grouping: a list of names, SQL text or Columns, and / or ``"dims"``."""
    if group_by is None:
        return [], False
    entries = [group_by] if isinstance(group_by, str) else list(group_by)
    by_dims = any(isinstance(g, str) and g == GROUP_DIMS for g in entries)
    return [g for g in entries if not (isinstance(g, str) and g == GROUP_DIMS)], by_dims


def apply_rollup(outputs: Sequence[Output], merge_rules: Mapping[str, str | None] | None) -> list[Output]:
    """Give each stored measure the aggregation of its suffix, or the one ``merge_rules`` names.

    The column keeps its name either way. A rule of None leaves the column out, for names that
    only look like a measure.
    """
    rules = dict(merge_rules or {})
    outputs = [o for o in outputs if rules.get(o.name, o) is not None]
    for o in outputs:
        if o.role == FCT and not o.computed and o.agg is None:
            o.agg = rules[o.name] if o.name in rules else suffix_agg(o.name)
    return outputs


def build(
    df: DataFrame,
    outputs: Sequence[Output],
    *,
    group_by=None,
    always_group: bool = False,
    having: Condition = None,
    partitions: Sequence[str] = (),
) -> DataFrame:
    """Select ``outputs`` from ``df``, grouped when anything in them aggregates.

    Every dimension is a grouping key unless it is marked otherwise; facts are aggregated or
    aggregate expressions. Grouping without an aggregate gives the distinct combinations.
    """
    explicit, by_dims = group_keys(group_by)
    aggregating = any(o.agg for o in outputs)
    order = canonical_order([o.name for o in outputs], partitions)
    if not (aggregating or always_group or explicit or by_dims):
        if having is not None:
            raise ValueError("having needs an aggregation or a group_by")
        return put(df.select(*[o.column.alias(o.name) for o in outputs]), outputs, order)

    bare = [
        o.name
        for o in outputs
        if o.role == FCT and o.agg is None and not o.computed and o.name not in explicit
    ]
    if bare:
        raise ValueError(f"facts without an aggregation in a grouped select: {bare}")

    implicit = aggregating or always_group or by_dims
    keys: dict[str, Column] = {}
    for o in outputs:
        if o.role == DIM and not o.exclude_from_group_by and (implicit or o.name in explicit):
            keys[o.name] = o.column
    for o in outputs:
        if o.role == FCT and o.name in explicit:
            keys[o.name] = o.column
    for i, g in enumerate(explicit):
        if not (isinstance(g, str) and g in keys):
            keys[f"group key {i}"] = as_column(g)

    # A computed output that repeats an explicit key is taken from the key after grouping.
    measures = [
        (_aggregate(df, o) if o.agg else o.column).alias(o.name) for o in outputs if o.name not in keys
    ]
    grouped = df.groupBy(*[c.alias(n) for n, c in keys.items()])
    if measures:
        result = grouped.agg(*measures)
    else:
        result = df.select(*[c.alias(n) for n, c in keys.items()]).distinct()
    condition = as_condition(having)
    if condition is not None:
        result = result.where(condition)
    return put(result, outputs, order)


def _aggregate(df: DataFrame, o: Output) -> Column:
    kind = column_type(df, o.column) if o.agg == "hll" else None
    return agg_column(o.agg, o.column, o.source, kind)


def sort_keys(order_by) -> list[Column]:
    """Names or (name, "asc" | "desc") pairs as sort keys, nulls last."""
    keys = []
    for entry in [order_by] if isinstance(order_by, str) else order_by:
        name, direction = (entry, "asc") if isinstance(entry, str) else entry
        if direction not in ("asc", "desc"):
            raise ValueError(f"direction must be asc or desc, not {direction!r}")
        column = F.col(ident(name))
        keys.append(column.desc_nulls_last() if direction == "desc" else column.asc_nulls_last())
    return keys


def order_limit(df: DataFrame, order_by=None, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Sort by names or (name, "asc" | "desc") pairs with nulls last, then cut.

    With a limit Spark keeps the top rows of each partition instead of sorting everything. All rows before an
    offset pass through one task; ``lamella.operators.paging`` is for deep ones.
    """
    if order_by:
        df = df.orderBy(*sort_keys(order_by))
    for label, value in (("limit", limit), ("offset", offset)):
        if value is not None and value < 1:
            raise ValueError(f"{label} must be at least 1")
    if offset is not None:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)
