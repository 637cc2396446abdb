"""Which dates changed at the source, and what must be recomputed because of it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.scalars import distinct_values, join_sorted
from lamella.operators.dates import (
    Range,
    column_type,
    date_literal,
    in_event_time,
    month_start,
    on_dates,
    parse_dates,
    to_ranges,
)
from lamella.operators.predicates import filter_where
from lamella.sources.spec import SourceSpec


def scan_dates(dates, lookback_days: int = 0, grain: str = "day") -> list[dt.date]:
    """Partition dates that may hold late rows of the event dates: each date and the days after it."""
    days = [d + dt.timedelta(days=i) for d in parse_dates(dates) for i in range((lookback_days or 0) + 1)]
    return sorted({month_start(d) if grain == "month" else d for d in days})


def scan_ranges(dates, lookback_days: int = 0, grain: str = "day") -> list[Range]:
    """The same partitions as half-open ranges, neighbours merged."""
    return to_ranges(scan_dates(dates, lookback_days, grain), "month" if grain == "month" else "day")


def scan_window(df: DataFrame, spec: SourceSpec, dates) -> DataFrame:
    """Rows of the event dates, reading only the partitions that may hold them."""
    lookback = (spec.tracking.lookback_days if spec.tracking else 0) or 0
    df = filter_where(df, spec.where)
    part = spec.partition_date
    if part is not None:
        kind = part.data_type or column_type(df, part.expr)
        grain = part.grain or "day"
        wanted = scan_dates(dates, lookback, grain)
        df = df.where(on_dates(F.expr(part.expr), wanted, kind, grain, bool(part.use_range)))
    time = F.expr(spec.event_time.expr)
    kind = column_type(df, spec.event_time.expr).simpleString()
    if kind == "string":
        time, kind = time.cast("timestamp_ntz"), "timestamp_ntz"
    return df.where(in_event_time(time, parse_dates(dates), kind))


def date_profile(df: DataFrame, spec: SourceSpec, dates=None) -> DataFrame:
    """Per event date: how many rows there are and which partition dates hold them.

    Rows are first counted per pair of dates, so only one row per pair reaches the second step
    and the list of partition dates stays short.
    """
    rows = filter_where(df, spec.where) if dates is None else scan_window(df, spec, dates)
    event = F.expr(spec.event_time.expr)
    partition = F.expr(spec.partition_date.expr) if spec.partition_date else event
    pairs = rows.groupBy(
        event.cast("timestamp_ntz").cast("date").alias("event_date"),
        partition.cast("timestamp_ntz").cast("date").alias("partition_date"),
    ).agg(F.count(event).alias("event_count"))
    return pairs.groupBy("event_date").agg(
        F.sum("event_count").alias("event_count"),
        distinct_values("partition_date").alias("partition_dates"),
    )


def candidate_dates(sources: DataFrame, source_dates: DataFrame, run_date: dt.date | Column) -> DataFrame:
    """Event dates to look at, for every source at once.

    ``sources`` has source_id, etl_type, date_delay, backfill_start and lookback_days. The base
    date is the run date less the delay. A ``run_schedule`` source gets only that. Others also
    get the days since their backfill start that were never recorded (up to where the lookback
    begins), and the lookback days themselves where they do not precede the backfill start.
    """
    run = run_date if isinstance(run_date, Column) else F.lit(run_date)
    lookback = F.coalesce(F.col("lookback_days"), F.lit(0))
    based = sources.withColumn("base", F.date_sub(run.cast("date"), F.coalesce(F.col("date_delay"), F.lit(0))))
    start, scheduled = F.col("backfill_start").cast("date"), F.col("etl_type").eqNullSafe("run_schedule")

    base = based.select("source_id", F.col("base").alias("event_date"))
    counted = based.where(~scheduled)
    last_fill = F.date_sub(F.date_sub(F.col("base"), lookback), 1)
    missing = (
        counted.where(start <= last_fill)
        .select("source_id", F.explode(F.sequence(start, last_fill)).alias("event_date"))
        .join(
            source_dates.where(F.col("etl_timestamp").isNotNull()).select("source_id", "event_date"),
            ["source_id", "event_date"],
            "left_anti",
        )
    )
    recent = (
        counted.where(lookback > 0)
        .select(
            "source_id",
            start.alias("start"),
            F.explode(F.sequence(F.date_sub(F.col("base"), lookback), F.date_sub(F.col("base"), 1))).alias(
                "event_date"
            ),
        )
        .where(F.col("start").isNull() | (F.col("event_date") >= F.col("start")))
        .drop("start")
    )
    return base.unionByName(missing).unionByName(recent).distinct()


def changed_dates(
    profile: DataFrame,
    source_dates: DataFrame,
    base_date: dt.date | Column | None = None,
    updated: DataFrame | None = None,
) -> DataFrame:
    """Rows of a new profile that differ from what was recorded.

    A date counts as changed when it was never recorded, has no run time, holds another number
    of rows, or was updated (``updated``: event_date, updated_timestamp) after its last run.
    Dates after ``base_date`` are left out.
    """
    keys = [k for k in ("source_id", "event_date") if k in profile.columns]
    old = source_dates.select(
        *keys, F.col("event_count").alias("old_count"), F.col("etl_timestamp").alias("old_run")
    )
    joined = profile.join(old.withColumn("known", F.lit(True)), keys, "left")
    changed = (
        F.col("known").isNull()
        | F.col("old_run").isNull()
        | ~F.col("event_count").eqNullSafe(F.col("old_count"))
    )
    if updated is not None:
        on = [k for k in keys if k in updated.columns]
        latest = updated.groupBy(*on).agg(F.max("updated_timestamp").alias("updated_timestamp"))
        joined = joined.join(latest, on, "left")
        changed = changed | F.coalesce(F.col("updated_timestamp") > F.col("old_run"), F.lit(False))
    if base_date is not None:
        limit = base_date if isinstance(base_date, Column) else date_literal(base_date)
        joined = joined.where(F.col("event_date") <= limit)
    return joined.where(changed).select(*profile.columns)


def model_limits(sources: DataFrame, source_models: DataFrame) -> DataFrame:
    """Per model, over all sources above it: the latest backfill start and the longest lookback."""
    return (
        source_models.join(sources, "source_id")
        .groupBy("model_id")
        .agg(
            F.max(F.col("backfill_start").cast("date")).alias("backfill_start"),
            F.max("lookback_days").alias("lookback_days"),
        )
    )


def successful_runs(model_dates: DataFrame, test_dates: DataFrame) -> DataFrame:
    """Latest successful run of each model and date in which no test failed."""
    keys = ["model_id", "event_date", "etl_timestamp"]
    failed = test_dates.where("test_status <> 'pass'").select(*keys).distinct()
    good = model_dates.where("run_status = 'success'").join(failed, keys, "left_anti")
    return good.groupBy("model_id", "event_date").agg(F.max("etl_timestamp").alias("model_run"))


def due_dates(
    source_models: DataFrame,
    source_dates: DataFrame,
    model_dates: DataFrame,
    test_dates: DataFrame,
    limits: DataFrame | None = None,
) -> DataFrame:
    """(model, date) pairs whose source was recorded after the model's last good run."""
    wanted = (
        source_models.join(source_dates.where(F.col("etl_timestamp").isNotNull()), "source_id")
        .groupBy("model_id", "event_date")
        .agg(F.max("etl_timestamp").alias("source_run"))
    )
    if limits is not None:
        wanted = wanted.join(limits.select("model_id", "backfill_start"), "model_id", "left").where(
            F.col("backfill_start").isNull() | (F.col("event_date") >= F.col("backfill_start"))
        )
    done = successful_runs(model_dates, test_dates)
    return (
        wanted.join(done, ["model_id", "event_date"], "left")
        .where(F.col("model_run").isNull() | (F.col("source_run") > F.col("model_run")))
        .select("model_id", "event_date")
    )


def date_batches(due: DataFrame, date_limit: int | None = None, id_column: str = "model_id") -> DataFrame:
    """Dates that ask for the same set of ids, newest first, ``date_limit`` dates to a batch.

    Works on the list of due dates: one row per date after the first step, whose ids are the
    project's models.
    """
    per_date = due.groupBy("event_date").agg(distinct_values(id_column).alias("ids"))
    if date_limit is None:
        batched = per_date.withColumn("batch", F.lit(0))
    else:
        newest = Window.partitionBy("ids").orderBy(F.col("event_date").desc())
        position = F.row_number().over(newest) - 1
        batched = per_date.withColumn("batch", F.floor(position / date_limit).cast("int"))
    dates = F.sort_array(F.collect_list("event_date"), asc=False)
    return batched.groupBy("ids", "batch").agg(dates.alias("event_dates"))


def _at(timestamp: dt.datetime | Column) -> Column:
    return (timestamp if isinstance(timestamp, Column) else F.lit(timestamp)).cast("timestamp_ntz")


def failed_dates(model_dates: DataFrame, etl_timestamp) -> DataFrame:
    """(model, date) pairs that failed in a run and are to be run again."""
    this_run = model_dates.where(F.col("etl_timestamp") == _at(etl_timestamp))
    return this_run.where("run_status = 'error'").select("model_id", "event_date").distinct()


def compaction_due(model_dates: DataFrame, asof, delay_days: int) -> DataFrame:
    """(model, date) pairs to compact: never compacted and last run more than ``delay_days`` ago,
    or run again more than that many days after their last compaction."""
    never = F.col("optimize_timestamp").isNull() & (
        F.timestamp_diff("DAY", F.col("etl_timestamp"), _at(asof)) > delay_days
    )
    again = F.timestamp_diff("DAY", F.col("optimize_timestamp"), F.col("etl_timestamp")) > delay_days
    due = model_dates.where("run_status = 'success'").where(never | F.coalesce(again, F.lit(False)))
    return due.select("model_id", "event_date").distinct()


def _shown(message: str, characters: int | None) -> Column:
    return F.col(message) if characters is None else F.substring(message, 1, characters).alias(message)


def failure_summary(model_dates: DataFrame, etl_timestamp, characters: int | None = None) -> DataFrame:
    """Failed models of a run: status, message, and their dates in order.

    Messages are told apart as a whole; ``characters`` only shortens what is shown of each.
    """
    failed = model_dates.where(F.col("etl_timestamp") == _at(etl_timestamp)).where("run_status <> 'success'")
    # Each date once per model in a run; the list is as long as the run has dates.
    dates = join_sorted(F.col("event_date").cast("string"))
    grouped = failed.groupBy("model_id", "run_status", "run_message").agg(dates.alias("event_dates"))
    return grouped.select("model_id", "run_status", _shown("run_message", characters), "event_dates")


def failed_tests(test_dates: DataFrame, etl_timestamp, characters: int | None = None) -> DataFrame:
    """Failed tests of a run, each message once; ``characters`` shortens what is shown."""
    failed = test_dates.where(F.col("etl_timestamp") == _at(etl_timestamp)).where("test_status <> 'pass'")
    once = failed.select("test_id", "model_id", "test_status", "test_message").distinct()
    return once.select("test_id", "model_id", "test_status", _shown("test_message", characters))
