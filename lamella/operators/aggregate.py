"""Re-aggregatable measures: the aggregation is the suffix of the column name."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions import sketches
from lamella.names import AGGS

def suffix_agg(name: str) -> str | None:
    """The aggregation a column carries in its name, if any."""
    stem, _, tail = name.rpartition("_")
    return tail if stem and tail in AGGS else None


def agg_name(name: str, agg: str, override_suffix: bool = False) -> str:
    """Output name of an aggregate: the suffix is added unless it is already there."""
    if agg not in AGGS:
        raise ValueError(f"unknown aggregation {agg!r}, expected one of {AGGS}")
    return f"{name}_{agg}" if override_suffix or suffix_agg(name) != agg else name


def agg_column(agg: str, column: Column, source: str, data_type: T.DataType | None = None) -> Column:
    """Aggregate ``column``, whose input name is ``source``.

    An input that already carries the aggregation is merged instead: counts are summed and
    sketches united.
    """
    merging = suffix_agg(source) == agg
    if agg == "count":
        return F.sum(column) if merging else F.count(column)
    if agg == "hll":
        return sketches.hll_merge(column) if merging else sketches.hll_build(column, data_type)
    if agg == "tdigest":
        return sketches.quantile_merge(column) if merging else sketches.quantile_build(column)
    if agg in ("sum", "min", "max"):
        return getattr(F, agg)(column)
    raise ValueError(f"unknown aggregation {agg!r}, expected one of {AGGS}")


def is_aggregate_expr(df: DataFrame, expr: str | Column | None) -> bool:
    """Whether an expression over ``df`` aggregates rows, as Spark's analyzer sees it.

    Beside another column an aggregate is refused unless the select groups; a window expression is
    not. Nothing runs.
    """
    if expr is None:
        return False
    column = F.expr(expr) if isinstance(expr, str) else expr
    # A generated column is no constant, so it cannot stand beside a global aggregate.
    beside = df.withColumn("beside aggregate", F.monotonically_increasing_id())
    try:
        beside.select(F.col("`beside aggregate`"), column.alias("aggregate"))
    except AnalysisException as error:
        if error.getCondition() in ("MISSING_GROUP_BY", "MISSING_AGGREGATION"):
            return True
        raise
    return False
