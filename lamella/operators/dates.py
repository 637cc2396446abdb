"""Event dates: the explicit set of days a run works on, and the filters it puts on reads."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.names import NAMES, Names
from lamella.operators.roles import ident, tied

Date = dt.date
Range = tuple[dt.date, dt.date]

def parse_dates(text: str | Iterable[dt.date]) -> list[dt.date]:
    """``2024-01-01``, ``2024-01-01,2024-01-03`` or ``2024-01-01~2024-01-05`` (inclusive).

    Order is kept and repeated dates are dropped. Lists of dates pass through.
    """
    if not isinstance(text, str):
        found = list(text)
    elif "~" in text:
        start, end = (dt.date.fromisoformat(part.strip()) for part in text.split("~"))
        found = [start + dt.timedelta(days=i) for i in range((end - start).days + 1)]
    else:
        found = [dt.date.fromisoformat(part.strip()) for part in text.split(",")]
    if not found:
        raise ValueError("a run needs at least one event date")
    return list(dict.fromkeys(found))


def month_start(day: dt.date) -> dt.date:
    return day.replace(day=1)


def next_month(day: dt.date) -> dt.date:
    return (day.replace(day=1) + dt.timedelta(days=31)).replace(day=1)


def month_starts(dates: Iterable[dt.date]) -> list[dt.date]:
    return list(dict.fromkeys(month_start(d) for d in dates))


def full_months(dates: Iterable[dt.date]) -> list[dt.date]:
    """The dates plus every other day of each month they touch."""
    dates = list(dict.fromkeys(dates))
    days = [
        first + dt.timedelta(days=i)
        for first in month_starts(dates)
        for i in range((next_month(first) - first).days)
    ]
    return list(dict.fromkeys(dates + days))


def to_grain(dates: Iterable[dt.date], grain: str = "day") -> list[dt.date]:
    if grain == "month":
        return month_starts(dates)
    if grain == "year":
        return list(dict.fromkeys(d.replace(month=1, day=1) for d in dates))
    if grain in ("day", "hour"):
        return list(dict.fromkeys(dates))
    raise ValueError(f"unknown date grain {grain!r}")


def to_ranges(dates: Iterable[dt.date], grain: str = "day") -> list[Range]:
    """Half-open ranges covering exactly the given days, months or years; neighbours are merged."""
    ends = {
        "day": lambda d: d + dt.timedelta(days=1),
        "month": next_month,
        "year": lambda d: d.replace(year=d.year + 1),
    }
    end_of = ends["day" if grain == "hour" else grain]
    merged: list[list[dt.date]] = []
    for start in sorted(to_grain(dates, grain)):
        if merged and merged[-1][1] == start:
            merged[-1][1] = end_of(start)
        else:
            merged.append([start, end_of(start)])
    return [(start, end) for start, end in merged]


def date_literal(day: dt.date, data_type: str | T.DataType = "date") -> Column:
    """A run date as a literal of the type of the column it is compared with."""
    kind = data_type if isinstance(data_type, str) else data_type.simpleString()
    if kind in ("string", "varchar"):
        return F.lit(day.isoformat())
    if kind == "date":
        return F.lit(day)
    if kind in ("timestamp", "timestamp_ntz", "datetime"):
        return F.lit(dt.datetime(day.year, day.month, day.day)).cast(
            "timestamp" if kind == "timestamp" else "timestamp_ntz"
        )
    raise ValueError(f"dates cannot be compared with a column of type {kind}")


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def in_dates(column: Column, dates, data_type="date", grain: str = "day") -> Column:
    """``column IN (dates)``; literals of the column's own type, so partitions are pruned.

    The first and last date are bounds of their own: where the column is computed from a time, Spark
    can carry bounds to the file scan, and a list it cannot.
    """
    wanted = to_grain(dates, grain)
    found = column.isin([date_literal(d, data_type) for d in wanted])
    if len(wanted) < 2:
        return found
    ends = [date_literal(d, data_type) for d in (min(wanted), max(wanted))]
    return (column >= ends[0]) & (column <= ends[1]) & found


def in_ranges(column: Column, dates, data_type="date", grain: str = "day") -> Column:
    """OR of half-open ranges, one per run of neighbouring dates."""
    return _any(
        [
            (column >= date_literal(start, data_type)) & (column < date_literal(end, data_type))
            for start, end in to_ranges(dates, grain)
        ]
    )


def on_dates(column: Column, dates, data_type="date", grain: str = "day", use_range: bool = False) -> Column:
    return (in_ranges if use_range else in_dates)(column, dates, data_type, grain)


def in_event_time(column: Column, dates, data_type="timestamp_ntz", grain: str = "day") -> Column:
    """Rows whose event time falls on one of the dates (or in their months).

    Equal to truncating the time and testing membership, but written as bounds on the bare
    column: those reach the file scan, a truncated column does not.
    """
    return in_ranges(column, dates, data_type, grain)


def column_type(df: DataFrame, expr: str | Column) -> T.DataType:
    """Type of an expression over ``df``; analysis only, nothing runs."""
    return df.select(F.expr(expr) if isinstance(expr, str) else expr).schema[0].dataType


def dates_table(spark: SparkSession, dates: Iterable[dt.date], name: str = NAMES.event_date) -> DataFrame:
    """The run's dates as a one-column table."""
    rows = [(d,) for d in dict.fromkeys(dates)]
    return spark.createDataFrame(rows, T.StructType([T.StructField(name, T.DateType(), False)]))


def date_filter(
    df: DataFrame,
    dates,
    *,
    layer: str = "int",
    grain: str | None = None,
    include_full_month: bool = False,
    exclude_daily_filter: bool = False,
    exclude_date_filter: bool = False,
    names: Names = NAMES,
) -> DataFrame:
    """Keep the rows of a model that belong to the run's dates.

    Each of the monthly and daily partition columns the model has is filtered, except those
    finer than the grain the reader aggregates to. Marts are never filtered.

    A list of months says nothing that Spark can carry to a scan of event times. Where the model still has the day
    or the time its months are cut from (and nothing computed in between), the months are ranges of these too.
    """
    if dates is None or layer == "mart" or exclude_date_filter:
        return df
    dates = parse_dates(dates)
    usable = [c for c in (names.monthly, names.daily) if c in df.columns and c not in names.finer_than(grain)]
    for name in usable:
        if name == names.daily and (exclude_daily_filter or include_full_month):
            continue
        column = F.col(ident(name))
        df = df.where(
            in_dates(column, dates, df.schema[name].dataType, "month" if name == names.monthly else "day")
        )
    finer = next((c for c in (names.daily, names.datetime) if tied(df, names.monthly, c)), None)
    if names.monthly in usable and finer is not None:
        df = df.where(in_ranges(F.col(ident(finer)), dates, df.schema[finer].dataType, "month"))
    return df


def _as_days(dates) -> list[Column]:
    return [F.lit(d) for d in dates]


def recorded_partitions(
    source_dates: DataFrame, source_id: str, dates, include_full_month: bool = False
) -> DataFrame:
    """Partition dates that held the run's event dates at the last change scan.

    Falls back to the run's own dates when nothing is recorded for them.
    """
    dates = parse_dates(dates)
    wanted = full_months(dates) if include_full_month else dates
    recorded = (
        source_dates.where(F.col("source_id") == source_id)
        .where(F.col("event_date").isin(_as_days(wanted)))
        .select(F.explode("partition_dates").alias("partition_date"))
        .distinct()
    )
    own = dates_table(source_dates.sparkSession, dates, "partition_date")
    return recorded.unionByName(own.where(recorded.agg(F.count(F.lit(1))).scalar() == 0))


def recorded_partition_filter(
    df: DataFrame,
    expr: str,
    source_dates: DataFrame,
    source_id: str,
    dates,
    *,
    data_type="date",
    grain: str = "day",
    include_full_month: bool = False,
    use_range: bool = False,
    compile_dates: bool = True,
) -> DataFrame:
    """Read only the partitions recorded for the run's dates.

    The recorded list, a few dates for each of the run's own, is looked up first and written into
    the plan as literals, which prunes files. With ``compile_dates=False`` it is joined at run
    time. Both keep the same rows: those whose value is one of the dates (or of their months,
    at that grain), or with ``use_range`` lies within one.
    """
    partitions = recorded_partitions(source_dates, source_id, dates, include_full_month)
    if compile_dates:
        found = sorted(r[0] for r in partitions.collect())
        return df.where(on_dates(F.expr(expr), found, data_type, grain, use_range))
    kind = data_type if isinstance(data_type, str) else data_type.simpleString()
    target = {"varchar": "string", "datetime": "timestamp_ntz"}.get(kind, kind)
    date = F.col("partition_date")
    day = F.trunc(date, "month") if grain == "month" else date
    if not use_range:
        return df.where(F.expr(expr).isin(partitions.select(day.cast(target)).distinct()))
    # A value lies within a day (or month) exactly when cutting it off there gives that date.
    moment = F.expr(expr).cast("timestamp_ntz")
    own = F.trunc(moment, "month") if grain == "month" else moment.cast("date")
    return df.where(own.isin(partitions.select(day).distinct()))
