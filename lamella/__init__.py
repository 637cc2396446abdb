"""Layered analytics models as plain PySpark functions.

Every function takes DataFrames and returns a lazy DataFrame; only the writers in
``lamella.operators.incremental`` and the control tables run jobs.
"""

from lamella.functions.macros import register_macro
from lamella.names import NAMES, Names, partition_columns
from lamella.operators.checks import checks_for, run_checks
from lamella.operators.dates import date_filter, dates_table, full_months, month_starts, parse_dates
from lamella.operators.incremental import Table, compact_partitions, table_for, write_incremental
from lamella.operators.intervals import Between
from lamella.operators.joins import Join
from lamella.operators.paging import Pages, deep_page
from lamella.operators.predicates import all_true, any_true, compare, exists, is_in, not_exists, not_in, outer
from lamella.operators.rollups import (
    bitmap_counts,
    bucket_metrics,
    bucket_quantile,
    distinct_bitmaps,
    merge_bitmaps,
    merge_buckets,
    quantile_buckets,
)
from lamella.operators.roles import canonical_order, dims, facts, with_roles
from lamella.operators.select import all_from, dim, dims_from, facts_from, fct, grain
from lamella.plans.metrics import Metric, in_the_past, metric_query, standard_metric, time_interval
from lamella.plans.models import (
    join_models,
    lookback_distinct_model,
    lookback_model,
    mart,
    rollup_model,
    select_model,
    union_models,
    unnest_model,
)
from lamella.session import tune
from lamella.sources.spec import EventTime, PartitionDate, PartitionPredicate, SourceSpec, Tracking
from lamella.sources.staging import read_source, stage_source, stage_union
from lamella.sources.tables import describe_table, preview, read_seed, read_table, refresh_from_parent

__all__ = [
    "NAMES",
    "Between",
    "EventTime",
    "Join",
    "Metric",
    "Names",
    "Pages",
    "PartitionDate",
    "PartitionPredicate",
    "SourceSpec",
    "Table",
    "Tracking",
    "all_from",
    "all_true",
    "any_true",
    "bitmap_counts",
    "bucket_metrics",
    "bucket_quantile",
    "canonical_order",
    "checks_for",
    "compact_partitions",
    "compare",
    "date_filter",
    "dates_table",
    "deep_page",
    "describe_table",
    "dim",
    "dims",
    "dims_from",
    "distinct_bitmaps",
    "exists",
    "facts",
    "facts_from",
    "fct",
    "full_months",
    "grain",
    "in_the_past",
    "is_in",
    "join_models",
    "lookback_distinct_model",
    "lookback_model",
    "mart",
    "merge_bitmaps",
    "merge_buckets",
    "metric_query",
    "month_starts",
    "not_exists",
    "not_in",
    "outer",
    "parse_dates",
    "partition_columns",
    "preview",
    "quantile_buckets",
    "read_seed",
    "read_source",
    "read_table",
    "refresh_from_parent",
    "register_macro",
    "rollup_model",
    "run_checks",
    "select_model",
    "stage_source",
    "stage_union",
    "standard_metric",
    "table_for",
    "time_interval",
    "tune",
    "union_models",
    "unnest_model",
    "with_roles",
    "write_incremental",
]
