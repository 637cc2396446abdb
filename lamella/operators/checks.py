"""Data checks: each returns the failing rows, none when the data is right."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lamella.names import NAMES, Names
from lamella.operators.dates import in_dates, parse_dates
from lamella.operators.predicates import Condition, all_true, as_condition, filter_where
from lamella.operators.roles import ident

# What a failing row-count check says.
LEFT_JOIN_GREW = "the left join repeats rows of its base: a key matches more than once"
JOIN_GREW = "the model has more rows than its base: a join repeats some of them"
LEFT_JOIN_LOST = "the left join has fewer rows than its base"


def not_null(df: DataFrame, column: str, where: Condition = None) -> DataFrame:
    """Rows in which the column is null."""
    return filter_where(df, where).where(F.col(ident(column)).isNull())


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls per column, all columns in one scan."""
    counted = df.agg(*[F.count_if(F.col(ident(c)).isNull()).alias(c) for c in columns])
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(ident(c)).alias("nulls")) for c in columns]
    )
    return counted.select(F.inline(pairs)).where("nulls > 0")


def unique(df: DataFrame, column: str | Sequence[str], where: Condition = None) -> DataFrame:
    """Values that occur more than once, with how often; nulls are not compared."""
    columns = [column] if isinstance(column, str) else list(column)
    present = reduce(lambda a, b: a & b, [F.col(ident(c)).isNotNull() for c in columns])
    counted = filter_where(df, where).where(present).groupBy(*columns)
    return counted.agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def accepted_values(df: DataFrame, column: str, values: Sequence, where: Condition = None) -> DataFrame:
    """Values outside the list, with how often they occur."""
    outside = filter_where(df, where).where(~F.col(ident(column)).isin(list(values)))
    return outside.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))


def relationships(
    df: DataFrame, column: str, parent: DataFrame, parent_column: str, where: Condition = None
) -> DataFrame:
    """Keys without a parent, with how often they occur.

    Keys are counted before they are joined, so a very frequent key is one row in the join.
    """
    child = F.col(ident(column))
    keys = filter_where(df, where).where(child.isNotNull()).groupBy(child.alias(column))
    keys = keys.agg(F.count(F.lit(1)).alias("n_rows"))
    known = parent.select(F.col(ident(parent_column)).alias("parent key"))
    return keys.join(known, child == F.col(ident("parent key")), "left_anti")


def _counted(df: DataFrame, dates, names: Names) -> DataFrame:
    if dates is not None:
        column = F.col(ident(names.daily))
        df = df.where(in_dates(column, parse_dates(dates), df.schema[names.daily].dataType))
    return df.agg(F.count(F.lit(1)).alias("n"))


def _row_counts(model, parent, dates, join_type, names) -> DataFrame | None:
    if names.daily not in model.columns or names.daily not in parent.columns:
        return None
    counts = _counted(parent, dates, names).select(
        F.col("n").alias("parent_row_count"),
        _counted(model, dates, names).scalar().alias("current_row_count"),
    )
    return counts.select(
        "*",
        (F.col("current_row_count") - F.col("parent_row_count")).alias("row_count_diff"),
        F.lit(join_type).cast("string").alias("join_type"),
    )


def equal_row_count(
    model: DataFrame,
    parent: DataFrame,
    dates=None,
    join_type: str | None = "left",
    mode: str = "strict",
    names: Names = NAMES,
) -> DataFrame | None:
    """Left joins keep their parent's row count; one failing row when it differs.

    ``mode="increase"`` fails only when rows were added. None when the check does not apply:
    another join type, or a side without the daily partition.
    """
    if mode not in ("strict", "increase"):
        raise ValueError("mode must be strict or increase")
    if (join_type or "").lower() != "left":
        return None
    counts = _row_counts(model, parent, dates, join_type, names)
    if counts is None:
        return None
    failed = counts.where("row_count_diff > 0" if mode == "increase" else "row_count_diff <> 0")
    message = F.when(F.col("row_count_diff") > 0, LEFT_JOIN_GREW).otherwise(LEFT_JOIN_LOST)
    return failed.withColumn("test_result", message)


def equal_or_lower_row_count(
    model: DataFrame, parent: DataFrame, dates=None, join_type: str | None = None, names: Names = NAMES
) -> DataFrame | None:
    """A filtering join may lose rows but not add any. None without the daily partition."""
    counts = _row_counts(model, parent, dates, join_type, names)
    if counts is None:
        return None
    return counts.where("row_count_diff > 0").withColumn("test_result", F.lit(JOIN_GREW))


def no_null_aggregates(
    df: DataFrame,
    column: str,
    dates=None,
    date_column: str = NAMES.daily,
    date_type: str | None = None,
) -> DataFrame:
    """Dates on which the sum of the column is null."""
    key = F.col(ident(date_column))
    if dates is not None:
        kind = date_type or df.schema[date_column].dataType
        df = df.where(in_dates(key, parse_dates(dates), kind))
    sums = df.groupBy(key.alias(date_column)).agg(F.sum(F.col(ident(column))).alias("total"))
    return sums.where(F.col("total").isNull()).select(date_column)


@dataclass(frozen=True)
class Check:
    """A check chosen for a model; ``join_type`` or ``column`` says what it looks at."""

    name: str
    join_type: str | None = None
    column: str | None = None


def checks_for(
    join_types: Sequence[str],
    agg_columns: Sequence[str] = (),
    equal_for: Sequence[str] | None = None,
    equal_or_lower_for: Sequence[str] | None = None,
) -> list[Check]:
    """Checks that fit a model of this shape.

    Any left join asks for equal row counts, other joins for no more rows, every aggregate for
    no null sums. With ``equal_for`` / ``equal_or_lower_for`` the row-count checks are instead
    those of the first join whose type is listed.
    """
    chosen: list[Check] = []
    if equal_for is None and equal_or_lower_for is None:
        if join_types:
            # A check looks at one kind of join and passes over others: name the one it was chosen for.
            left = "left" in join_types
            name = "equal_row_count" if left else "equal_or_lower_row_count"
            chosen.append(Check(name, join_type="left" if left else join_types[0]))
    else:
        for name, listed in (
            ("equal_row_count", equal_for),
            ("equal_or_lower_row_count", equal_or_lower_for),
        ):
            found = next((t for t in join_types if t in (listed or ())), None)
            if found:
                chosen.append(Check(name, join_type=found))
    return chosen + [Check("no_null_aggregates", column=c) for c in agg_columns]


_UNITS = {"minute": 60, "hour": 3600, "day": 86400}


def _seconds(limit: tuple[int, str] | None) -> int | None:
    return None if limit is None else limit[0] * _UNITS[limit[1]]


def freshness(
    df: DataFrame,
    loaded_at: str,
    asof: dt.datetime | Column | None = None,
    warn_after: tuple[int, str] | None = None,
    error_after: tuple[int, str] | None = None,
    where: Condition = None,
) -> DataFrame:
    """Age of the newest row against limits such as ``(12, "hour")``; no limit, no alarm."""
    now = F.current_timestamp() if asof is None else asof if isinstance(asof, Column) else F.lit(asof)
    newest = filter_where(df, where).agg(F.max(F.expr(loaded_at)).cast("timestamp_ntz").alias("max_loaded_at"))
    aged = newest.withColumn(
        "age_seconds", F.timestamp_diff("SECOND", F.col("max_loaded_at"), now.cast("timestamp_ntz"))
    )
    status = F.lit("pass")
    for label, limit in (("warn", _seconds(warn_after)), ("error", _seconds(error_after))):
        if limit is not None:
            too_old = F.col("age_seconds").isNull() | (F.col("age_seconds") > limit)
            status = F.when(too_old, F.lit(label)).otherwise(status)
    return aged.withColumn("status", status)


@dataclass(frozen=True)
class Counted:
    """A check whose failing rows one aggregate can count, so that many such checks share one read of the model.

    Called with a model it gives the failing rows, like any other check. ``count`` is an aggregate of the model;
    ``rows``, where given, counts rows by a condition alone, which also works while the model is written.
    """

    failing: Callable[[DataFrame], DataFrame | None]
    count: Callable[[DataFrame], Column | None]
    rows: Callable[[DataFrame], Column] | None = None

    def __call__(self, df: DataFrame) -> DataFrame | None:
        return self.failing(df)


def rows_where(condition: Condition) -> Counted:
    """No row may satisfy the condition."""
    counted = F.count_if(as_condition(condition))
    return Counted(lambda df: filter_where(df, condition), lambda df: counted, lambda df: counted)


def no_nulls(column: str, where: Condition = None) -> Counted:
    """``not_null`` as a check that can share a read."""
    counted = F.count_if(all_true(where, F.col(ident(column)).isNull()))
    return Counted(lambda df: not_null(df, column, where), lambda df: counted, lambda df: counted)


def only_values(column: str, values: Sequence, where: Condition = None) -> Counted:
    """``accepted_values`` as a check that can share a read; while writing it counts rows, not different values."""
    outside = all_true(where, ~F.col(ident(column)).isin(list(values)))
    distinct = F.count_distinct(F.when(outside, F.col(ident(column))))
    return Counted(lambda df: accepted_values(df, column, values, where), lambda df: distinct, lambda df: F.count_if(outside))


def same_row_count(
    parent: DataFrame, dates=None, join_type: str | None = "left", mode: str = "strict", names: Names = NAMES
) -> Counted:
    """``equal_row_count`` as a check that can share a read of the model; the parent is counted once."""

    def failing(df: DataFrame) -> DataFrame | None:
        return equal_row_count(df, parent, dates, join_type, mode, names)

    return Counted(failing, lambda df: None if failing(df) is None else _differs(df, parent, dates, mode != "strict", names))


def no_more_rows(parent: DataFrame, dates=None, join_type: str | None = None, names: Names = NAMES) -> Counted:
    """``equal_or_lower_row_count`` as a check that can share a read of the model."""

    def failing(df: DataFrame) -> DataFrame | None:
        return equal_or_lower_row_count(df, parent, dates, join_type, names)

    return Counted(failing, lambda df: None if failing(df) is None else _differs(df, parent, dates, True, names))


def _differs(df: DataFrame, parent: DataFrame, dates, only_more: bool, names: Names) -> Column:
    """1 where the model has more rows than its parent, or another number of them."""
    if dates is None:
        mine = F.count(F.lit(1))
    else:
        kind = df.schema[names.daily].dataType
        mine = F.count_if(in_dates(F.col(ident(names.daily)), parse_dates(dates), kind))
    theirs = _counted(parent, dates, names).scalar()
    return F.when(mine > theirs if only_more else mine != theirs, 1).otherwise(0)


def run_checks(df: DataFrame, checks: Mapping[str, Callable[[DataFrame], DataFrame | None]]) -> DataFrame:
    """Run named checks on a model: failing rows and pass / fail / skip for each.

    A check is any function from the model to its failing rows; None means it does not apply. All checks that are
    ``Counted`` share one read of the model, the others read it themselves.
    """
    if not checks:
        raise ValueError("no checks given")
    counts = {n: c.count(df) for n, c in checks.items() if isinstance(c, Counted)}
    shared = {n: c.cast("bigint").alias(f"check {k}") for k, (n, c) in enumerate(counts.items()) if c is not None}
    results = []
    if shared:
        found = df.agg(*shared.values())
        pairs = [F.struct(F.lit(n).alias("check"), F.col(ident(c)).alias("failing_rows")) for n, c in zip(shared, found.columns)]
        results.append(found.select(F.inline(F.array(*pairs))))
    for name, check in checks.items():
        if name in shared:
            continue
        failing = None if isinstance(check, Counted) else check(df)
        if failing is None:
            one = df.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("failing_rows"))
        else:
            one = failing.agg(F.count(F.lit(1)).alias("failing_rows"))
        results.append(one.select(F.lit(name).alias("check"), "failing_rows"))
    return _judged(reduce(DataFrame.unionByName, results))


def _judged(found: DataFrame) -> DataFrame:
    status = F.when(F.col("failing_rows").isNull(), "skip").when(F.col("failing_rows") > 0, "fail").otherwise("pass")
    return found.select("check", "failing_rows", status.alias("status"))


class Watched:
    """Checks made while a model is written, without another read of it.

    ``model`` is the model to write; after the write ``results`` has one row for each check. Spark counts the rows
    of a task again when it has to run it again, so a number of failing rows is exact unless an executor was
    lost, and pass or fail is right in any case. Checks that are not made of rows alone are refused.
    """

    def __init__(self, df: DataFrame, checks: Mapping[str, Counted]):
        fit = [n for n, c in checks.items() if not (isinstance(c, Counted) and c.rows)]
        if fit or not checks:
            raise ValueError(f"only checks that count rows can be made while writing, not {fit}")
        self.spark, self.names, self.seen = df.sparkSession, list(checks), Observation()
        counts = [c.rows(df).alias(f"check {k}") for k, c in enumerate(checks.values())]
        self.model = df.observe(self.seen, *counts)

    def results(self) -> DataFrame:
        found = self.seen.get
        rows = [(n, found[f"check {k}"]) for k, n in enumerate(self.names)]
        return _judged(self.spark.createDataFrame(rows, "check string, failing_rows bigint"))
