"""Metric queries: dimensions, metrics and filters evaluated over a mart."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions import sketches
from lamella.functions.scalars import trunc_date, trunc_to
from lamella.names import NAMES, Names
from lamella.operators.aggregate import suffix_agg
from lamella.operators.grouping import order_limit
from lamella.operators.percentile import exact_percentiles
from lamella.operators.predicates import Condition, filter_where
from lamella.operators.roles import field_metadata, ident
from lamella.operators.select import as_column

# Quantile metrics of a sketch column.
QUANTILES = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p98": 0.98}

# Kinds of custom metrics. The last four take an aggregate expression.
CUSTOM = (
    "average",
    "count",
    "count_distinct",
    "max",
    "median",
    "min",
    "percentile",
    "sum",
    "boolean",
    "date",
    "number",
    "string",
)

# Parts of a time a dimension can be cut to or reduced to.
INTERVALS = (
    "RAW",
    "HOUR",
    "DAY",
    "WEEK",
    "MONTH",
    "QUARTER",
    "YEAR",
    "DAY_OF_WEEK_INDEX",
    "DAY_OF_WEEK_NAME",
    "DAY_OF_MONTH_NUM",
    "DAY_OF_YEAR_NUM",
    "WEEK_NUM",
    "MONTH_NUM",
    "MONTH_NAME",
    "QUARTER_NUM",
    "QUARTER_NAME",
    "YEAR_NUM",
)

# Intervals offered for an event time of a given grain.
INTERVALS_BY_GRAIN = {
    "hour": ("DAY", "DAY_OF_WEEK_NAME", "HOUR", "MONTH", "WEEK", "YEAR"),
    "day": ("DAY", "DAY_OF_WEEK_NAME", "MONTH", "WEEK", "YEAR"),
    "month": ("MONTH", "YEAR"),
    "year": ("YEAR",),
}


@dataclass(frozen=True)
class Metric:
    """One number per group.

    ``kind`` is a custom kind, with ``sql`` the column or expression it works on, or one of the
    standard metrics of a stored measure (see ``standard_metric``).
    """

    name: str
    kind: str
    sql: Column | str | None = None
    percentile: float | None = None
    filters: Condition = None

    def __post_init__(self):
        if self.kind not in CUSTOM:
            raise ValueError(f"unknown metric kind {self.kind!r}, expected one of {CUSTOM}")


def standard_metric(column: str, metric: str, agg: str | None = None, name: str | None = None) -> Metric | None:
    """A standard metric of a measure column: avg, count, sum, min, max, distinctcount, p50 … p98.

    ``agg`` is the aggregation the column carries, by default that of its name. None when the
    metric does not fit it. ``avg`` takes the bare name and needs its ``_sum`` and ``_count``.
    """
    named = suffix_agg(column)
    agg = agg or named
    stem = column.removesuffix(f"_{agg}") if agg else column
    label = name or f"metric_{stem}_{metric}"
    col = F.col(ident(column))
    if metric == "avg":
        total, count = F.sum(F.col(ident(f"{column}_sum"))), F.sum(F.col(ident(f"{column}_count")))
        return Metric(label, "number", F.when(count == 0, F.lit(0.0)).otherwise(total / count))
    if metric == "count" and agg == "count":
        return Metric(label, "sum" if named == "count" else "count", col)
    if metric in ("max", "min", "sum") and agg == metric:
        return Metric(label, metric, col)
    if metric == "distinctcount" and agg == "hll":
        return Metric(label, "number", sketches.hll_estimate(col))
    if metric in QUANTILES and agg == "tdigest":
        return Metric(label, "number", sketches.quantile_estimate(col, QUANTILES[metric]))
    return None


def time_interval(column: Column | str, interval: str) -> Column:
    """Cut a time to an interval, or reduce it to one of its parts. Weeks begin on Monday."""
    if interval not in INTERVALS:
        raise ValueError(f"unknown interval {interval!r}, expected one of {INTERVALS}")
    c = F.col(column) if isinstance(column, str) else column
    parts = {
        "RAW": lambda: c,
        "HOUR": lambda: trunc_to("hour", c),
        "DAY": lambda: trunc_date("day", c),
        "WEEK": lambda: trunc_date("week", c),
        "MONTH": lambda: trunc_date("month", c),
        "QUARTER": lambda: trunc_date("quarter", c),
        "YEAR": lambda: trunc_date("year", c),
        "DAY_OF_WEEK_INDEX": lambda: F.weekday(c),
        "DAY_OF_WEEK_NAME": lambda: F.date_format(c, "EEEE"),
        "DAY_OF_MONTH_NUM": lambda: F.dayofmonth(c),
        "DAY_OF_YEAR_NUM": lambda: F.dayofyear(c),
        "WEEK_NUM": lambda: F.weekofyear(c),
        "MONTH_NUM": lambda: F.month(c),
        "MONTH_NAME": lambda: F.date_format(c, "MMMM"),
        "QUARTER_NUM": lambda: F.quarter(c),
        "QUARTER_NAME": lambda: F.concat(F.lit("Q"), F.quarter(c).cast("string")),
        "YEAR_NUM": lambda: F.year(c),
    }
    return parts[interval]()


def metric_time_column(df: DataFrame, names: Names = NAMES) -> str:
    """Column the event time of a mart is grouped by: its finest partition column."""
    for name in (names.hourly, names.daily, names.monthly):
        if name in df.columns:
            return name
    return names.datetime


def in_the_past(column: Column | str, amount: int, unit: str = "days", asof: dt.date | Column | None = None) -> Column:
    """From ``amount`` days or months before ``asof`` (default today) through the whole day ``asof``."""
    c = F.col(column) if isinstance(column, str) else column
    now = F.current_date() if asof is None else asof if isinstance(asof, Column) else F.lit(asof)
    starts = {"days": lambda: F.date_sub(now, amount), "months": lambda: F.add_months(now, -amount)}
    if unit not in starts:
        raise ValueError(f"unit must be days or months, not {unit!r}")
    return (c >= starts[unit]()) & (c < F.date_add(now, 1))


def default_window(df: DataFrame, names: Names = NAMES) -> tuple[int, str] | None:
    """The date filter a mart asks for by default: 14 days, or 2 months when it is only monthly."""
    if names.monthly not in df.columns:
        return None
    return (14, "days") if names.daily in df.columns else (2, "months")


def default_filter(df: DataFrame, asof: dt.date | Column | None = None, names: Names = NAMES) -> Column | None:
    """The condition of a mart's default date filter, to be given to ``metric_query(required=…)``."""
    window = default_window(df, names)
    if window is None:
        return None
    return in_the_past(ident(metric_time_column(df, names)), *window, asof)


def default_intervals(df: DataFrame, names: Names = NAMES) -> tuple[str, ...]:
    """Intervals to offer for a mart's event time: those its grain can answer.

    The grain is the one the time was cut to, else that of the finest partition column.
    """
    if names.datetime not in df.columns:
        return ()
    cut = field_metadata(df, names.datetime).get("interval")
    by_column = {names.hourly: "hour", names.daily: "day", names.monthly: "month"}
    return INTERVALS_BY_GRAIN[cut or by_column.get(metric_time_column(df, names), "hour")]


def equals_text(column: Column | str, value: str, case_sensitive: bool = True) -> Column:
    """Compare text, ignoring case on request."""
    c = F.col(column) if isinstance(column, str) else column
    return c == F.lit(value) if case_sensitive else F.lower(c) == F.lit(value.lower())


def _aggregate(metric: Metric) -> Column:
    if metric.kind in ("boolean", "date", "number", "string"):
        if metric.filters is not None:
            raise ValueError(f"metric {metric.name}: filters need a plain column")
        return as_column(metric.sql)
    value = F.lit(1) if metric.sql is None else as_column(metric.sql)
    if metric.filters is not None:
        value = F.when(as_column(metric.filters), value)
    kinds = {
        "average": F.avg,
        "count": F.count,
        "count_distinct": F.count_distinct,
        "max": F.max,
        "min": F.min,
        "sum": F.sum,
    }
    return kinds[metric.kind](value)


def _quantile(metric: Metric) -> float | None:
    if metric.kind == "median":
        return 0.5
    if metric.kind == "percentile":
        return 0.5 if metric.percentile is None else metric.percentile / 100
    return None


def metric_query(
    df: DataFrame,
    dims: Sequence[str] | Mapping[str, Column | str] = (),
    metrics: Sequence[Metric | None] = (),
    *,
    filters: Sequence[Condition] = (),
    table_filter: Condition = None,
    required: Condition = None,
    having: Condition = None,
    order_by=None,
    limit: int | None = None,
) -> DataFrame:
    """Metrics per group of dimensions, under the query's filters and the mart's own.

    ``table_filter`` always holds for the mart; ``required`` is the filter every query of it must
    carry, such as ``default_filter``.

    All metrics share one aggregation. Medians and percentiles are exact: they are computed
    beside it, one pass per column, and joined on the dimensions.
    """
    metrics = [m for m in metrics if m is not None]
    if not metrics:
        raise ValueError("a metric query needs at least one metric")
    named = dict(dims) if isinstance(dims, Mapping) else {d: F.col(ident(d)) for d in dims}
    rows = filter_where(df, table_filter, required, *filters)
    plain = [m for m in metrics if _quantile(m) is None]
    keys = [as_column(c).alias(n) for n, c in named.items()]
    count = [F.count(F.lit(1)).alias("group rows")]
    result = rows.groupBy(*keys).agg(*[_aggregate(m).alias(m.name) for m in plain] or count)

    for value, wanted in _by_value([m for m in metrics if _quantile(m) is not None]):
        source = rows if value[1] is None else rows.where(as_column(value[1]))
        column = as_column(value[0])
        keyed = source.select(*keys, column.alias("metric value"))
        found = exact_percentiles(
            keyed, list(named), F.col("`metric value`"), {m.name: _quantile(m) for m in wanted}
        )
        result = _left(result, found, list(named))
    condition = filter_where(result, having)
    return order_limit(condition.select(*named, *[m.name for m in metrics]), order_by, limit)


def _by_value(metrics: Sequence[Metric]):
    """Percentile metrics grouped by the column and filter they share."""
    groups: dict[tuple, tuple] = {}
    for m in metrics:
        groups.setdefault((str(m.sql), str(m.filters)), ((m.sql, m.filters), []))[1].append(m)
    return list(groups.values())


def _left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not keys:
        return left.select("*", *[right.select(ident(c)).scalar().alias(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(ident("l", k)).eqNullSafe(F.col(ident("r", k))) for k in keys])
    joined = left.alias("l").join(right.alias("r"), same, "left")
    return joined.select("l.*", *[F.col(ident("r", c)) for c in right.columns if c not in keys])

