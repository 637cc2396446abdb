"""Long trailing windows without a copy of every day for every event date.

Two ways, for measures already reduced to one row per day and dimension set:

* A *sweep* for measures that can be taken back (counts, sums of whole and decimal numbers): a day adds its
  measures when it enters the windows and takes them back when it leaves, two rows whatever the length of the window.
  Running totals per dimension set are the results.
* *Dyadic blocks* for all others (extremes, sketches, sums of floating numbers, which differences would make
  inexact): each day belongs to one block of 1, 2, 4 ... days of every size, blocks are aggregated, and a window
  of N days is made of at most 2 log2(N) of them.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.operators.roles import ident

#: Day 0 of the blocks.
EPOCH = dt.date(1970, 1, 1)

Block = tuple[int, int]


def decompose(first: int, last: int) -> list[Block]:
    """(level, start) of the fewest aligned blocks of 2**level days that make up first .. last."""
    blocks = []
    while first <= last:
        level = (last - first + 1).bit_length() - 1
        while first % (1 << level):
            level -= 1
        blocks.append((level, first))
        first += 1 << level
    return blocks


def window_blocks(dates: Sequence[dt.date], days: int, first: int) -> list[tuple[int, int, dt.date]]:
    """(level, start, event date) of the blocks of each event date's window."""
    found = []
    for e in sorted(set(dates)):
        at = (e - EPOCH).days
        found += [(level, start, e) for level, start in decompose(at - days, at - first)]
    return found


def blocks_of(day: Column, levels: int) -> Column:
    """(level, start) of the blocks a day belongs to, one of each size."""
    number = F.unix_date(day.cast("date"))
    every = [
        F.struct(F.lit(k).alias("level"), (number - F.pmod(number, F.lit(1 << k))).alias("start")) for k in range(levels)
    ]
    return F.array(*every)


def block_table(df: DataFrame, dates: Sequence[dt.date], days: int, first: int) -> DataFrame:
    """Which blocks feed which event date: at most 2 log2(days) rows for each date of the run."""
    rows = [{"level": a, "start": b, "event": e.isoformat()} for a, b, e in window_blocks(dates, days, first)]
    one = df.sparkSession.range(1).select(F.from_json(F.lit(json.dumps(rows)), _BLOCKS).alias("rows"))
    return one.select(F.inline("rows"))


_BLOCKS = "array<struct<level: int, start: int, event: date>>"


def levels_for(days: int, first: int) -> int:
    """How many sizes of blocks windows of this length are made of."""
    return (days - first + 1).bit_length()


def _event_dates(dates: Sequence[dt.date], start: Column, end: Column) -> Column:
    """The event dates from start to before end."""
    every = F.from_json(F.lit(json.dumps([d.isoformat() for d in sorted(set(dates))])), "array<date>")
    return F.filter(every, lambda d: (d >= start) & (d < end))


def swept(
    changes: DataFrame, keys: Sequence[str], at: str, measures: Mapping[str, Column], dates: Sequence[dt.date], present: str
) -> DataFrame:
    """Running totals of ``changes`` per key set on each event date on which ``present`` is above 0.

    ``at`` is the date from which a change holds. A key set has at most one row per date once changes are
    summed, so its running totals fit any task.
    """
    summed = changes.groupBy(*[F.col(ident(k)) for k in keys], F.col(at).alias("swept at")).agg(
        *[c.alias(n) for n, c in measures.items()]
    )
    order = Window.partitionBy(*[F.col(ident(k)) for k in keys], F.lit(0)).orderBy("swept at")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.lit(max(dates) + dt.timedelta(days=1))
    totals = summed.select(
        *[F.col(ident(k)) for k in keys],
        F.col("swept at"),
        F.coalesce(F.lead("swept at").over(order), last).alias("swept until"),
        *[F.sum(F.col(ident(n))).over(so_far).alias(n) for n in measures],
    )
    held = _event_dates(dates, F.col("swept at"), F.col("swept until"))
    return totals.where(F.col(ident(present)) > 0).withColumn("event", F.explode(held)).drop("swept at", "swept until")


def entering_and_leaving(df: DataFrame, day: str, days: int, first: int, sign: str, at: str) -> DataFrame:
    """Each row twice: as it enters the windows and, with sign -1, as it leaves them."""
    moment = F.col(ident(day)).cast("date")
    both = F.array(
        F.struct(F.lit(1).alias("sign"), F.date_add(moment, first).alias("at")),
        F.struct(F.lit(-1).alias("sign"), F.date_add(moment, days + 1).alias("at")),
    )
    found = df.select("*", F.explode(both).alias("swept change"))
    return found.select(*[F.col(ident(c)) for c in df.columns], F.expr("`swept change`.sign").alias(sign), F.expr("`swept change`.at").alias(at))


def can_be_taken_back(data_type: T.DataType) -> bool:
    """Whether sums of the type stay exact when rows are taken back."""
    return isinstance(data_type, (T.IntegralType, T.DecimalType))


def influence(df: DataFrame, keys: Sequence[str], value: str, day: str, days: int, first: int) -> DataFrame:
    """+1 and -1 where a value starts and stops to be seen by the windows of its key set.

    A value's days become disjoint intervals of event dates: a day reaches from ``day + first`` to ``day + days``, and an
    interval goes on as long as the next day's begins before it ends. Nothing is repeated: two rows for each
    interval, at most two for each day.
    """
    moment = F.col(ident(day)).cast("date")
    names = [F.col(ident(k)) for k in keys]
    seen = df.select(*names, F.col(ident(value)).alias("swept value"), moment.alias("swept day")).where("`swept value` IS NOT NULL").distinct()
    order = Window.partitionBy(*names, F.col("swept value")).orderBy("swept day")
    reach, start = F.date_add("swept day", days + 1), F.date_add("swept day", first)
    near = {"swept before": F.lag("swept day").over(order), "swept next": F.lead("swept day").over(order)}
    starts = F.coalesce(start > F.date_add("swept before", days + 1), F.lit(True))
    stops = F.coalesce(F.date_add("swept next", first) > reach, F.lit(True))
    ends = F.filter(
        F.array(
            F.when(starts, F.struct(F.lit(1).alias("sign"), start.alias("at"))),
            F.when(stops, F.struct(F.lit(-1).alias("sign"), reach.alias("at"))),
        ),
        lambda x: x.isNotNull(),
    )
    return seen.withColumns(near).select(*names, F.inline(ends))
