"""Staging: read a source under its filters and give it time columns and a row count."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.names import DIM, FCT, NAMES, Names
from lamella.operators.dates import (
    column_type,
    full_months,
    in_event_time,
    on_dates,
    parse_dates,
    recorded_partition_filter,
)
from lamella.operators.predicates import Condition, filter_where
from lamella.operators.roles import TIME, canonical_order, united
from lamella.operators.select import Item, Output, Scope, put, resolve
from lamella.sources.spec import PartitionPredicate, SourceSpec

_STATIC = {
    "eq": operator.eq,
    "neq": operator.ne,
    "gt": operator.gt,
    "gte": operator.ge,
    "lt": operator.lt,
    "lte": operator.le,
}


def static_filter(df: DataFrame, predicate: PartitionPredicate) -> DataFrame:
    """Compare a partition expression with a fixed value.

    The value is cast, not the column, so that the comparison still prunes files.
    """
    value = F.lit(predicate.value).cast(column_type(df, predicate.expr))
    return df.where(_STATIC[predicate.kind](F.expr(predicate.expr), value))


def read_source(
    df: DataFrame,
    spec: SourceSpec,
    dates=None,
    *,
    source_dates: DataFrame | None = None,
    include_full_month: bool = False,
    use_event_dates_for_partitions: bool = False,
) -> DataFrame:
    """Apply every filter a read of the source carries: dates, partitions and the static one."""
    wanted = None
    if dates is not None:
        dates = parse_dates(dates)
        wanted = full_months(dates) if include_full_month else dates

    part = spec.partition_date
    if part is not None and dates is not None:
        kind = part.data_type or column_type(df, part.expr)
        if part.use_event_dates or use_event_dates_for_partitions or source_dates is None:
            grain = part.grain or "day"
            df = df.where(on_dates(F.expr(part.expr), wanted, kind, grain, bool(part.use_range)))
        else:
            df = recorded_partition_filter(
                df,
                part.expr,
                source_dates,
                spec.source_id,
                dates,
                data_type=kind,
                grain=part.grain or "day",
                include_full_month=include_full_month,
                use_range=bool(part.use_range),
                compile_dates=part.compile_dates is not False,
            )

    for predicate in spec.partitions or ():
        if predicate.kind != "event_dates":
            df = static_filter(df, predicate)
        elif wanted is not None:
            kind = predicate.data_type or column_type(df, predicate.expr)
            grain = predicate.grain or "day"
            df = df.where(on_dates(F.expr(predicate.expr), wanted, kind, grain, bool(predicate.use_range)))

    if spec.event_time is not None and wanted is not None:
        expr = F.expr(spec.event_time.expr)
        kind = column_type(df, spec.event_time.expr).simpleString()
        if kind == "string":
            expr, kind = expr.cast("timestamp_ntz"), "timestamp_ntz"
        df = df.where(in_event_time(expr, wanted, kind, spec.event_time.grain or "day"))

    return filter_where(df, spec.where)


def time_columns(spec: SourceSpec, names: Names = NAMES) -> list[Output]:
    """``datetime`` and the partition columns a source's event time gives."""
    if spec.event_time is None:
        return []
    # Date arithmetic on the zone-less time: the session's time zone plays no part.
    moment = f"cast({spec.event_time.expr} as timestamp_ntz)"
    day = f"cast({moment} as date)"
    built = {
        names.datetime: moment,
        names.daily: day,
        names.hourly: f"cast({day} as timestamp_ntz) + make_dt_interval(0, hour({moment}))",
        names.monthly: f"trunc({day}, 'month')",
    }
    cut = {TIME: f"{spec.source_id}: {spec.event_time.expr}"}
    return [Output(name, name, F.expr(text), DIM, computed=True, metadata=cut) for name, text in built.items()]


def stage_source(
    df: DataFrame,
    spec: SourceSpec,
    select: Sequence | None = None,
    *,
    where: Condition = None,
    dates=None,
    source_dates: DataFrame | None = None,
    include_full_month: bool = False,
    use_event_dates_for_partitions: bool = False,
    row_count: bool = True,
    partition_columns: bool = True,
    partitions: Sequence[str] | None = None,
    names: Names = NAMES,
) -> DataFrame:
    """One source as a staged model: filtered, projected, with time columns and a row count of 1."""
    df = filter_where(
        read_source(
            df,
            spec,
            dates,
            source_dates=source_dates,
            include_full_month=include_full_month,
            use_event_dates_for_partitions=use_event_dates_for_partitions,
        ),
        where,
    )
    outputs = {o.name: o for o in resolve(select or [Item(c) for c in df.columns], Scope.single(df))}
    for output in time_columns(spec, names):
        outputs.setdefault(output.name, output)
    if row_count and spec.row_count is not False:
        counted = Output(names.row_count, names.row_count, F.lit(1).cast("bigint"), FCT, computed=True)
        outputs.setdefault(names.row_count, counted)
    partitions = tuple(partitions or names.partitions)
    if not partition_columns:
        outputs = {n: o for n, o in outputs.items() if n not in partitions}
    chosen = list(outputs.values())
    staged = df.select(*[o.column.alias(o.name) for o in chosen])
    return put(staged, chosen, canonical_order(outputs, partitions))


def stage_union(
    sources: Sequence[tuple[DataFrame, SourceSpec]],
    select: Sequence | None = None,
    *,
    where: Condition = None,
    **options,
) -> DataFrame:
    """UNION ALL of sources: the same select list on each, under each source's own filters.

    Without a select list the columns of the first source are read from all of them.
    """
    if not sources:
        raise ValueError("a union needs at least one source")
    first = sources[0][0]
    chosen = select or [Item(c) for c in first.columns]
    branches = [stage_source(df, spec, chosen, where=where, **options) for df, spec in sources]
    names = options.get("names", NAMES)
    return united(branches, reduce(DataFrame.unionByName, branches), (names.datetime, *names.partitions))


