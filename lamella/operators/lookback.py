"""Trailing windows: each event date aggregates the rows of the days before it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.operators.dates import in_ranges


def window_days(dates: Sequence[dt.date], days: int, exclude_event_date: bool) -> list[dt.date]:
    """Every day that feeds at least one of the event dates."""
    if days < 0:
        raise ValueError("a lookback needs a number of days, 0 or more")
    first = 1 if exclude_event_date else 0
    return sorted({d - dt.timedelta(days=i) for d in dates for i in range(first, days + 1)})


def in_windows(df: DataFrame, daily: str, dates, days: int, exclude_event_date: bool) -> DataFrame:
    """Only the rows inside some window, as literal ranges that prune partitions."""
    needed = window_days(dates, days, exclude_event_date)
    return df.where(in_ranges(F.col(daily), needed, df.schema[daily].dataType))


def fed_dates(daily: str, dates, days: int, exclude_event_date: bool) -> Column:
    """The event dates a day contributes to.

    A row is repeated once for each of them, which turns the range condition between dates and
    rows into a plain grouping key: no nested loop, no join.
    """
    first, day = (1 if exclude_event_date else 0), F.col(daily)
    if first > days:
        return F.array().cast("array<date>")
    reach = F.sequence(F.date_add(day, first), F.date_add(day, days))
    return F.filter(reach, lambda d: d.isin([F.lit(x) for x in sorted(set(dates))]))
