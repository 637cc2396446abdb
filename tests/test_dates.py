import datetime as dt

import pytest
from pyspark.sql import functions as F

from lamella import Names, date_filter, dates_table, full_months, month_starts, parse_dates, partition_columns
from lamella.operators.dates import date_literal, in_dates, in_event_time, in_ranges, to_ranges


def d(text):
    return dt.date.fromisoformat(text)


def test_parse_single_list_range_and_repeats():
    assert parse_dates("2024-01-01") == [d("2024-01-01")]
    assert parse_dates("2024-01-03,2024-01-01,2024-01-03") == [d("2024-01-03"), d("2024-01-01")]
    assert parse_dates("2024-02-27~2024-03-01") == [
        d("2024-02-27"),
        d("2024-02-28"),
        d("2024-02-29"),
        d("2024-03-01"),
    ]
    assert parse_dates([d("2024-01-01")]) == [d("2024-01-01")]
    with pytest.raises(ValueError):
        parse_dates([])


def test_full_months_over_a_leap_february():
    days = full_months(parse_dates("2024-02-10,2024-02-11"))
    assert len(days) == 29 and days[:2] == parse_dates("2024-02-10,2024-02-11")
    assert month_starts(days) == [d("2024-02-01")]


def test_ranges_merge_neighbours():
    assert to_ranges(parse_dates("2024-01-02,2024-01-01,2024-01-05")) == [
        (d("2024-01-01"), d("2024-01-03")),
        (d("2024-01-05"), d("2024-01-06")),
    ]
    assert to_ranges(parse_dates("2023-12-31,2024-01-31"), "month") == [(d("2023-12-01"), d("2024-02-01"))]


def test_names_finer_than_a_grain():
    names = Names()
    assert names.finer_than(None) == () and names.finer_than("hour") == ()
    assert names.finer_than("day") == ("partition_hourly",)
    assert set(names.finer_than("month")) == {"partition_daily", "partition_hourly"}
    assert set(names.finer_than("year")) == set(names.partitions)
    assert partition_columns(["a"], ["b"]) == ("a",)
    assert partition_columns(None, ["b"]) == ("b",)
    assert partition_columns() == names.partitions
    with pytest.raises(ValueError):
        names.finer_than("week")


def test_midnight_and_month_borders(spark, rows):
    times = ["2024-01-31 23:59:59.999999", "2024-02-01 00:00:00", "2024-02-29 23:59:59", "2024-03-01 00:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    found = df.where(in_event_time(F.col("t"), parse_dates("2024-02-10"), grain="month"))
    assert [str(r.t) for r in found.orderBy("t").collect()] == ["2024-02-01 00:00:00", "2024-02-29 23:59:59"]
    assert df.where(in_event_time(F.col("t"), parse_dates("2024-01-31"))).count() == 1


def test_dates_compare_in_the_type_of_the_column(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-02",)], "s string")
    assert df.where(in_dates(F.col("s"), parse_dates("2024-01-02"), "varchar")).count() == 1
    ranged = in_ranges(F.col("s"), parse_dates("2024-01-01~2024-01-02"), "varchar")
    assert df.where(ranged).count() == 2
    with pytest.raises(ValueError):
        date_literal(d("2024-01-01"), "bigint")


def test_date_filter_scope(spark):
    df = spark.createDataFrame(
        [("2024-01-05",), ("2024-01-06",), ("2024-02-05",)], "day string"
    ).selectExpr("cast(day as date) AS partition_daily", "trunc(cast(day as date), 'MM') AS partition_monthly")
    count = lambda **k: date_filter(df, "2024-01-05", **k).count()
    assert count() == 1
    assert count(exclude_daily_filter=True) == 2
    assert count(include_full_month=True) == 2
    assert count(grain="month") == 2
    assert count(grain="year") == 3
    assert count(layer="mart") == 3
    assert count(exclude_date_filter=True) == 3
    assert date_filter(df, None).count() == 3


def test_dates_table(spark, rows):
    table = dates_table(spark, parse_dates("2024-01-01,2024-01-01,2024-01-02"))
    assert rows(table) == [(d("2024-01-01"),), (d("2024-01-02"),)]


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(10).selectExpr("id", "date_add(date'2024-01-01', cast(id as int)) AS partition_daily")
    df.write.partitionBy("partition_daily").parquet(path)
    plan = date_filter(spark.read.parquet(path), "2024-01-05~2024-01-06")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(partition_daily" in plan or "PartitionFilters: [partition_daily" in plan


def test_date_lists_reach_the_scan_as_bounds(spark):
    from lamella import EventTime, SourceSpec, rollup_model, select_model, stage_source

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    staged = stage_source(events, SourceSpec("events", EventTime("ts")), ["event_type"])
    plan = rollup_model(select_model(staged), "day", dates="2024-01-05~2024-01-11")._jdf.queryExecution().toString()
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(ts,2024-01-05" in pushed and "LessThan(ts,2024-01-12" in pushed
