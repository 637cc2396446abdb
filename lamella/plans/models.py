"""The model types: each is one function from DataFrames to a lazy DataFrame."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.names import DIM, FCT, NAMES, Names
from lamella.operators import trailing
from lamella.operators.aggregate import agg_name, is_aggregate_expr, suffix_agg
from lamella.operators.dates import date_filter, parse_dates
from lamella.operators.grouping import apply_rollup, build, group_keys, order_limit
from lamella.operators.interval_counts import Asked, count_name, pair_counts
from lamella.operators.joins import Join, add_scalars, join_all
from lamella.operators.lookback import fed_dates, in_windows
from lamella.operators.predicates import Condition, as_condition, filter_where
from lamella.operators.roles import ident, role_of, united
from lamella.operators.select import (
    Bulk,
    Item,
    Output,
    Scope,
    grain,
    inherited,
    resolve,
    selected_grain,
)
from lamella.operators.unnest import unnest


def _computes_aggregate(df: DataFrame, select: Sequence | None) -> bool:
    return any(isinstance(i, Item) and not i.aggs and is_aggregate_expr(df, i.expr) for i in select or ())


def _outputs(
    scope: Scope,
    select: Sequence | None,
    *,
    rollup: str | None,
    datetime_expr: str | None,
    grouped: bool,
    inherit_time: bool,
    row_count: bool,
    partition_columns: bool,
    partitions: Sequence[str],
    names: Names,
) -> list[Output]:
    """The full list of result columns: time at the rollup grain, the select list, inherited ones."""
    base = scope.frame(None)
    chosen = list(select) if select is not None else None
    interval = rollup or selected_grain(chosen, names)
    dropped = set(names.finer_than(interval))
    if chosen is None:
        chosen = [Bulk("all")] if not rollup else [Bulk("dims"), Bulk("facts")]
    outputs: dict[str, Output] = {}

    def add(found) -> None:
        for o in found:
            outputs.setdefault(o.name, o)

    if rollup:
        expr = datetime_expr
        side = scope.base if scope.qualify else None
        add(resolve([grain(rollup, names.datetime, expr, side=side)], scope))
    found = resolve(chosen, scope)
    if rollup and select is None:
        found = [
            o
            for o in found
            if o.name not in dropped and (o.role == DIM or suffix_agg(o.name) or o.name == names.row_count)
        ]
    add(found)
    if inherit_time:
        for name in (names.datetime, *names.partitions):
            if name in base.columns and name not in dropped and not (name == names.datetime and interval):
                add([inherited(name, scope)])
    if names.row_count in base.columns and names.row_count not in outputs:
        add([inherited(names.row_count, scope)])
    count = outputs.get(names.row_count)
    if count is not None and grouped and count.agg is None and not count.computed:
        count.role, count.agg = FCT, "sum"
    if not row_count:
        outputs.pop(names.row_count, None)
    if not partition_columns:
        outputs = {n: o for n, o in outputs.items() if n not in partitions}
    return list(outputs.values())


def _model(
    df: DataFrame,
    scope: Scope,
    select: Sequence | None,
    *,
    where: Condition = None,
    group_by=None,
    having: Condition = None,
    order_by=None,
    limit: int | None = None,
    offset: int | None = None,
    rollup: str | None = None,
    datetime_expr: str | None = None,
    merge_rules: Mapping[str, str | None] | None = None,
    inherit_time: bool = True,
    row_count: bool = True,
    partition_columns: bool = True,
    partitions: Sequence[str] | None = None,
    names: Names = NAMES,
) -> DataFrame:
    partitions = tuple(partitions or names.partitions)
    computed = _computes_aggregate(df, select)
    explicit, by_dims = group_keys(group_by)
    listed = any(isinstance(i, Item) and i.aggs for i in select or ())
    outputs = _outputs(
        scope,
        select,
        rollup=rollup,
        datetime_expr=datetime_expr,
        grouped=bool(rollup or explicit or by_dims or listed or computed),
        inherit_time=inherit_time,
        row_count=row_count,
        partition_columns=partition_columns,
        partitions=partitions,
        names=names,
    )
    if rollup:
        outputs = apply_rollup(outputs, merge_rules)
    result = build(
        filter_where(df, where),
        outputs,
        group_by=group_by,
        always_group=bool(rollup) or computed,
        having=having,
        partitions=partitions,
    )
    return order_limit(result, order_by, limit, offset)


_FILTER_OPTIONS = ("layer", "include_full_month", "exclude_daily_filter", "exclude_date_filter")


def _split(options: dict) -> tuple[dict, dict]:
    filters = {k: options.pop(k) for k in _FILTER_OPTIONS if k in options}
    return filters, options


def select_model(df: DataFrame, select: Sequence | None = None, *, dates=None, **options) -> DataFrame:
    """One model: projection, conditions, grouping, having, rollup, order and limit.

    ``dates`` filters the partition columns of ``df`` (never for ``layer="mart"``). A rollup
    re-aggregates stored measures to a grain. Time, partition and row-count columns come along
    unless switched off; all other options are those of ``_model`` and ``date_filter``.
    """
    filters, options = _split(options)
    names = options.get("names", NAMES)
    interval = options.get("rollup") or selected_grain(select, names)
    df = date_filter(df, dates, grain=interval, names=names, **filters)
    return _model(df, Scope.single(df), select, **options)


def join_models(
    base: tuple[str, DataFrame],
    joins: Sequence[Join],
    select: Sequence | None = None,
    *,
    dates=None,
    scalars: Mapping[str, DataFrame] | None = None,
    **options,
) -> DataFrame:
    """Left-deep joins on a base model, then everything ``select_model`` does.

    Columns are addressed as ``alias.column``; the date filter applies to the base only. Tables
    in ``scalars`` have one row each and are made available to every row. Where an interval join is only counted,
    its pairs are not made: see ``lamella.operators.interval_counts``.
    """
    filters, options = _split(options)
    names = options.get("names", NAMES)
    alias, df = base
    interval = options.get("rollup") or selected_grain(select, names)
    df = date_filter(df, dates, grain=interval, names=names, **filters)
    sides = {alias: df, **{j.alias: j.df for j in joins}}
    if select is None:
        select = [Bulk("all", a) for a in sides]
    counted = _pair_counts(alias, df, joins, select, options, names) if not scalars else None
    if counted is not None:
        joined, select = counted
    else:
        joined = add_scalars(join_all(alias, df, joins), scalars or {})
    return _model(joined, Scope({**sides, **(scalars or {})}, alias, qualify=True), select, **options)


#: Counts of pairs: of all, of those with a value, of different values.
COUNT = re.compile(r"count\((?:\*|(distinct )?(\w+)\.(\w+))\)")


def _pair_counts(alias: str, df: DataFrame, joins: Sequence[Join], select: Sequence, options: Mapping, names: Names):
    """Partial counts of an interval join and a select list that adds them up; None if more than counts is asked."""
    hidden = {names.datetime, names.row_count, *names.partitions}
    if len(joins) != 1 or not joins[0].between or joins[0].on or set(options) - {"inherit_time"} or hidden & set(df.columns):
        return None
    join = joins[0]
    sides = {alias: df, join.alias: join.df}
    dims, counted, distinct, chosen, largest = [], [], [], [], False
    for item in select:
        item = Item(item) if isinstance(item, str) else item
        if not isinstance(item, Item) or item.exclude_from_group_by or item.interval:
            return None
        side, found = item.side or alias, None
        if isinstance(item.expr, str) and item.role == FCT and not item.aggs:
            found = COUNT.fullmatch(item.expr)
        if found:
            column = (found[2], found[3]) if found[2] else None
            if column and column[1] not in getattr(sides.get(column[0]), "columns", ()):
                return None
            if found[1]:
                distinct.append(column)
            else:
                counted.append(column)
                total = f"coalesce(cast(sum({ident(count_name(counted.index(column)))}) AS bigint), 0L)"
                item = Item(item.name, total, FCT, side=item.side)
        elif item.expr is not None or item.name not in getattr(sides.get(side), "columns", ()):
            return None
        elif item.role == DIM and not item.aggs:
            dims.append((side, item.name))
        elif item.role == FCT and item.aggs == ("max",) and f"{side}.{item.name}" == join.between.point:
            largest = True
        else:
            return None
        chosen.append(item)
    if not counted:
        return None
    asked = Asked(dims, counted, list(dict.fromkeys(distinct)), largest)
    rows = pair_counts((alias, df), (join.alias, join.df), join.how, join.between, asked)
    return None if rows is None else (rows, chosen)


def unnest_model(
    df: DataFrame,
    column: str,
    fields: Sequence[str],
    select: Sequence | None = None,
    *,
    json_schema=None,
    dates=None,
    **options,
) -> DataFrame:
    """One row per element of an array or map column, then everything ``select_model`` does."""
    filters, options = _split(options)
    names = options.get("names", NAMES)
    interval = options.get("rollup") or selected_grain(select, names)
    df = date_filter(df, dates, grain=interval, names=names, **filters)
    wide = unnest(df, column, fields, json_schema)
    return _model(wide, Scope.single(wide), select, **options)


def union_models(
    models: Sequence[DataFrame],
    select: Sequence | None = None,
    *,
    where: Condition = None,
    dates=None,
    **options,
) -> DataFrame:
    """UNION ALL: the same select list, date filter and condition on every branch.

    Without a select list the columns of the first model are taken from all of them.
    """
    if not models:
        raise ValueError("a union needs at least one model")
    chosen = select if select is not None else list(models[0].columns)
    roles = {c: role_of(models[0], c) for c in models[0].columns}
    chosen = [Item(c, role=roles.get(c, DIM)) if isinstance(c, str) and select is None else c for c in chosen]
    branches = [select_model(df, chosen, where=where, dates=dates, **options) for df in models]
    names = options.get("names", NAMES)
    return united(branches, reduce(DataFrame.unionByName, branches), (names.datetime, *names.partitions))


def rollup_model(
    df: DataFrame, interval: str, *, datetime_expr: str | None = None, dates=None, **options
) -> DataFrame:
    """Re-aggregate every stored measure of a model to hour, day, month or year."""
    return select_model(df, rollup=interval, datetime_expr=datetime_expr, dates=dates, **options)


def lookback_model(
    df: DataFrame,
    dates,
    days: int,
    select: Sequence,
    *,
    exclude_event_date: bool = False,
    where: Condition = None,
    having: Condition = None,
    group_by=None,
    pre_aggregate: bool = True,
    distinct_on: Sequence[str] | None = None,
    partitions: Sequence[str] | None = None,
    names: Names = NAMES,
) -> DataFrame:
    """For each event date, aggregate the rows of that day and the ``days`` before it.

    The result's daily partition is the event date. Measures are first reduced to one row per
    day and dimension set, and only those rows are repeated for the event dates they feed; select
    lists holding free aggregate expressions repeat the rows themselves. ``distinct_on`` names the
    columns such expressions read when it does not matter to them how often a row occurs (distinct
    counts, extremes): then only different rows of a day are repeated.

    Long windows over many dates repeat nothing: see ``lamella.operators.trailing``. ``lookback_distinct_model``
    counts different values exactly over them.
    """
    dates = parse_dates(dates)
    daily = names.daily
    df = filter_where(in_windows(df, daily, dates, days, exclude_event_date), where)
    hidden = (names.datetime, names.row_count, daily)
    outputs = [o for o in resolve(select, Scope.single(df)) if o.name not in hidden]
    mergeable = group_by is None and all(
        (o.agg if o.role == FCT else not o.exclude_from_group_by) for o in outputs
    )
    first = 1 if exclude_event_date else 0
    if pre_aggregate and mergeable:
        df, outputs = _per_day(df, outputs, daily)
        if min(len(dates), days - first + 1) > REPEATED and any(o.role == FCT for o in outputs):
            event = Output(daily, daily, F.col("event"), DIM, computed=True)
            windows = _swept if _all_taken_back(df, outputs) else _blocks
            kept = tuple(partitions or names.partitions)
            return windows(df, outputs, event, daily, dates, days, first, having, kept)
    elif distinct_on is not None and group_by is None:
        df, outputs = _distinct_per_day(df, outputs, daily, distinct_on)
    expanded = df.withColumn(
        names.event_date, F.explode(fed_dates(daily, dates, days, exclude_event_date))
    ).drop(daily)
    outputs.append(Output(daily, daily, F.col(names.event_date), DIM, computed=True))
    return build(
        expanded,
        outputs,
        group_by=group_by,
        always_group=True,
        having=having,
        partitions=tuple(partitions or names.partitions),
    )


#: Copies of a day up to which it is repeated for the dates it feeds.
REPEATED = 16


def _all_taken_back(df: DataFrame, outputs: Sequence[Output]) -> bool:
    """Whether every measure is a count or an exact sum."""
    return all(
        o.role == DIM or o.agg == "count" or (o.agg == "sum" and trailing.can_be_taken_back(df.schema[o.name].dataType))
        for o in outputs
    )


def _blocks(df, outputs, event, daily, dates, days, first, having, partitions) -> DataFrame:
    """Days to aligned blocks of days, blocks to the windows they make up."""
    levels = trailing.levels_for(days, first)
    blocks = df.select("*", F.explode(trailing.blocks_of(F.col(ident(daily)), levels)).alias("block")).drop(daily)
    key = Output("block", "block", F.col("block"), DIM)
    blocks = build(blocks, [key, *outputs])
    windows = trailing.block_table(df, dates, days, first)
    fed = blocks.join(windows, (F.col("block.level") == windows["level"]) & (F.col("block.start") == windows["start"]))
    return build(fed.drop("block", "level", "start"), [*outputs, event], always_group=True, having=having, partitions=partitions)


def _swept(df, outputs, event, daily, dates, days, first, having, partitions) -> DataFrame:
    """Days enter and leave the windows; running totals are the measures."""
    kinds = {o.name: df.schema[o.name].dataType for o in outputs if o.role == FCT}
    changes = trailing.entering_and_leaving(df, daily, days, first, "swept sign", "swept from")
    sign, measures = F.col("swept sign"), {"swept days": F.sum("swept sign")}
    for name, kind in kinds.items():
        # Wider than any total of the range; nulls are counted, since a sum of nulls only is null.
        value = F.col(ident(name)).cast(value_type(kind))
        measures[name] = F.coalesce(F.sum(F.when(sign > 0, value).otherwise(-value)), F.lit(0)).cast(value_type(kind))
        measures[f"swept {name}"] = F.sum(F.when(value.isNotNull(), sign).otherwise(0))
    keys = [o.name for o in outputs if o.role == DIM]
    totals = trailing.swept(changes, keys, "swept from", measures, dates, "swept days")
    for name, kind in kinds.items():
        totals = totals.withColumn(name, F.when(F.col(f"`swept {name}`") > 0, F.col(ident(name)).cast(total_type(kind))))
    chosen = [Output(o.name, o.source, F.col(ident(o.name)), o.role, metadata=o.metadata) for o in outputs]
    result = build(totals, [*chosen, event], partitions=partitions)
    condition = as_condition(having)
    return result if condition is None else result.where(condition)


def value_type(kind: T.DataType) -> T.DecimalType:
    return T.DecimalType(38, getattr(kind, "scale", 0))


def total_type(kind: T.DataType) -> T.DataType:
    """The type Spark gives a sum of stored measures."""
    return T.DecimalType(min(38, kind.precision + 10), kind.scale) if isinstance(kind, T.DecimalType) else T.LongType()


def lookback_distinct_model(
    df: DataFrame,
    dates,
    days: int,
    dimensions: Sequence[str],
    counted: Mapping[str, str],
    *,
    exclude_event_date: bool = False,
    where: Condition = None,
    partitions: Sequence[str] | None = None,
    names: Names = NAMES,
) -> DataFrame:
    """Exact numbers of different values over trailing windows of any length.

    ``counted`` maps result columns to the columns whose different non-null values are counted, for each
    combination of ``dimensions`` and each event date whose window has a row. Rows are not repeated: the days on
    which a value occurs become intervals of event dates, which add one when they begin and take it back when they end.
    """
    dates, first, daily = parse_dates(dates), 1 if exclude_event_date else 0, names.daily
    if first > days:
        raise ValueError("the window holds no day")
    df = filter_where(in_windows(df, daily, dates, days, exclude_event_date), where)
    dimensions = list(dimensions)
    # A row for each day says which windows have rows at all.
    rows = df.select(*[F.col(ident(d)) for d in dimensions], F.col(ident(daily))).distinct()
    present = trailing.entering_and_leaving(rows, daily, days, first, "sign", "at").drop(daily)
    changes = present.select(*[F.col(ident(d)) for d in dimensions], "at", F.lit(0).alias("swept measure"), "sign")
    for k, column in enumerate(counted.values(), 1):
        more = trailing.influence(df, dimensions, column, daily, days, first)
        more = more.select(*[F.col(ident(d)) for d in dimensions], "at", F.lit(k).alias("swept measure"), "sign")
        changes = changes.unionByName(more)
    measures = {
        name: F.sum(F.when(F.col("swept measure") == k, F.col("sign")).otherwise(0))
        for k, name in enumerate(["swept days", *counted])
    }
    totals = trailing.swept(changes, dimensions, "at", measures, dates, "swept days")
    roles = [Output(d, d, F.col(ident(d)), DIM) for d in dimensions]
    roles += [Output(n, n, F.col(ident(n)), FCT, computed=True) for n in counted]
    roles.append(Output(daily, daily, F.col("event"), DIM, computed=True))
    return build(totals, roles, partitions=tuple(partitions or names.partitions))


def _per_day(df: DataFrame, outputs: Sequence[Output], daily: str) -> tuple[DataFrame, list[Output]]:
    """Partial measures per day, and the outputs that merge them."""
    key = Output(daily, daily, F.col(ident(daily)), DIM)
    partial = build(df, [key, *outputs], partitions=(daily,))
    merged = []
    for o in outputs:
        # A partial measure is merged under its own aggregation; counts add up.
        source = agg_name(o.name, o.agg) if o.agg else o.name
        merged.append(Output(o.name, source, F.col(ident(o.name)), o.role, o.agg, metadata=o.metadata))
    return partial, merged


def _distinct_per_day(
    df: DataFrame, outputs: Sequence[Output], daily: str, read: Sequence[str]
) -> tuple[DataFrame, list[Output]]:
    """Different rows of a day in the dimensions and the columns the measures read."""
    dims = [o for o in outputs if o.role == DIM]
    kept = {daily: F.col(ident(daily)), **{o.name: o.column for o in dims}}
    kept |= {c: F.col(ident(c)) for c in read if c not in kept}
    rows = df.select(*[c.alias(n) for n, c in kept.items()]).distinct()
    plain = [Output(o.name, o.name, F.col(ident(o.name)), DIM, metadata=o.metadata) for o in dims]
    return rows, [*plain, *(o for o in outputs if o.role != DIM)]


def mart(df: DataFrame, view: str) -> DataFrame:
    """Publish a model as a view other SQL can read; nothing is stored."""
    df.createOrReplaceTempView(view)
    return df


