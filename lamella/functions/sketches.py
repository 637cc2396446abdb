"""Mergeable sketches for distinct counts and quantiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Types the distinct-count sketch hashes as they are; others are hashed as text.
_HASHED = (T.IntegerType, T.LongType, T.StringType, T.BinaryType)


def hll_build(column: Column, data_type: T.DataType | None = None) -> Column:
    return F.hll_sketch_agg(column if isinstance(data_type, _HASHED) else column.cast("string"))


def hll_merge(column: Column) -> Column:
    return F.hll_union_agg(column)


def hll_estimate(column: Column) -> Column:
    """Distinct count over all rows of a group of stored sketches."""
    return F.hll_sketch_estimate(F.hll_union_agg(column))


def quantile_build(column: Column) -> Column:
    return F.kll_sketch_agg_double(column.cast("double"))


def quantile_merge(column: Column) -> Column:
    return F.kll_merge_agg_double(column)


def quantile_estimate(column: Column, quantile: float) -> Column:
    """Value at a quantile over all rows of a group of stored sketches."""
    return F.kll_sketch_get_quantile_double(F.kll_merge_agg_double(column), F.lit(float(quantile)))
