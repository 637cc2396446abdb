"""Plans that must not read more than they need."""

import re

import pytest
from oracle import REGISTRY

from lamella import Join, date_filter, dim, join_models, select_model, stage_source, union_models
from lamella.operators.roles import tied
from queries.base import EVENTS

FOLDER = "/root/testdata/sf0.001"


def scans(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # plans name all filters
    plan = REGISTRY[name].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"FileScan parquet[^\n]*testdata[^\n]*", plan)


@pytest.mark.parametrize(
    "name, sources",
    [("join_full", 2), ("join_full_plain", 2), ("lookback_distinct", 1), ("rollup_day", 1)],
)
def test_sources_are_read_once(spark, name, sources):
    assert len(scans(spark, name)) == sources


@pytest.mark.parametrize("name, sources", [("metric_custom_median", 2), ("lookback_365d_counts", 1), ("lookback_distinct_90d", 3)])
def test_sources_are_read_once_when_run(spark, name, sources):
    """Once per pass over the rows: rounds of a percentile read the same counts again, not the source."""
    df = REGISTRY[name].run(spark, FOLDER)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet[^\n]*testdata", plan)) == sources


@pytest.mark.parametrize(
    "name, first, end",
    [
        ("rollup_month", "ts,2024-01-01", "ts,2024-02-01"),
        ("date_filter_month_of_orders", "o_orderdate,1996-02-01", "o_orderdate,1996-03-01"),
        ("date_filter_no_daily_of_orders", "o_orderdate,1996-02-01", "o_orderdate,1996-03-01"),
        ("date_filter_month_grain", "ts,2024-01-01", "ts,2024-02-01"),
    ],
)
def test_months_reach_the_scan(spark, name, first, end):
    (scan,) = scans(spark, name)
    pushed = scan.split("PushedFilters")[1]
    assert f"GreaterThanOrEqual({first}" in pushed and f"LessThan({end}" in pushed


@pytest.mark.parametrize("name", ["rollup_day", "join_agg_dates", "lookback_distinct"])
def test_dates_reach_the_scan(spark, name):
    assert any("GreaterThanOrEqual(ts,2024-01" in s and "LessThan(ts,2024-01" in s for s in scans(spark, name))


def test_months_are_ranges_only_of_days_they_are_cut_from(spark):
    """A daily column from elsewhere is not filtered by the months of another one."""
    staged = stage_source(spark.read.parquet(f"{FOLDER}/events.parquet"), EVENTS, ["event_id", "user_id"])
    assert tied(staged, "partition_monthly", "partition_daily")
    daily = select_model(staged, ["event_id", "user_id", dim("partition_daily", "date_add(partition_daily, 40)")])
    assert not tied(daily, "partition_monthly", "partition_daily")
    assert date_filter(daily, "2024-01-05", exclude_daily_filter=True).count() == staged.count()
    mixed = union_models([staged.drop("event_id"), daily.drop("event_id")])
    assert not tied(mixed, "partition_monthly", "partition_daily")
    assert date_filter(mixed, "2024-01-05", grain="month").count() == 2 * staged.count()
    both = union_models([staged, staged])
    assert tied(both, "partition_monthly", "partition_daily")
    joined = join_models(
        ("a", staged), [Join(staged, "b", ["event_id"])], ["event_id", dim("partition_daily", side="b")], dates="2024-01-05"
    )
    assert not tied(joined, "partition_monthly", "partition_daily")
