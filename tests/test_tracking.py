import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lamella import (
    EventTime,
    PartitionDate,
    SourceSpec,
    Table,
    Tracking,
    checks_for,
    parse_dates,
    run_checks,
    write_incremental,
)
from lamella.operators import changes, checks
from lamella.operators.checks import Check
from lamella.operators.control import ControlTables

SPEC = SourceSpec(
    "src", EventTime("event_datetime"), PartitionDate("partition_date"), tracking=Tracking(lookback_days=5)
)


def d(text):
    return dt.date.fromisoformat(text)


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_scanned_partitions_cover_late_days():
    dates = parse_dates("2024-01-01,2024-01-02")
    assert changes.scan_dates(dates, 5) == parse_dates("2024-01-01~2024-01-07")
    assert changes.scan_ranges(dates, 5) == [(d("2024-01-01"), d("2024-01-08"))]
    assert changes.scan_dates(parse_dates("2024-01-30"), 5, "month") == [d("2024-01-01"), d("2024-02-01")]
    assert changes.scan_ranges(parse_dates("2024-01-30"), 5, "month") == [(d("2024-01-01"), d("2024-03-01"))]
    assert changes.scan_dates(dates) == dates


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        ("2024-01-01 10:00:00", "2024-01-01"),
        ("2024-01-01 23:59:59", "2024-01-03"),
        ("2024-01-01 05:00:00", "2024-01-09"),
        ("2024-01-02 00:00:00", "2024-01-02"),
        ("2024-01-09 00:00:00", "2024-01-09"),
    ]
    return spark.createDataFrame(rows, "event_datetime string, partition_date string")


@pytest.mark.parametrize("use_range", [False, True])
def test_profile_counts_rows_and_partitions(events, rows, use_range):
    spec = replace(SPEC, partition_date=PartitionDate("partition_date", use_range=use_range))
    found = rows(changes.date_profile(events, spec, "2024-01-01,2024-01-02"))
    # The row that arrived eight days late lies outside the scanned partitions.
    assert found == [
        (d("2024-01-01"), 2, [d("2024-01-01"), d("2024-01-03")]),
        (d("2024-01-02"), 1, [d("2024-01-02")]),
    ]


def sources(spark, *rows):
    names = "source_id string, etl_type string, date_delay int, backfill_start date, lookback_days int"
    return spark.createDataFrame(list(rows), names)


def recorded(spark, *rows):
    names = "source_id string, event_date date, event_count bigint, etl_timestamp timestamp_ntz"
    return spark.createDataFrame(list(rows), names)


def test_candidates(spark, rows):
    known = recorded(spark, ("a", d("2024-01-03"), 1, at(4)), ("a", d("2024-01-04"), 1, None))
    src = sources(
        spark,
        ("a", None, 1, d("2024-01-02"), 2),
        ("b", "run_schedule", 0, d("2024-01-01"), 2),
        ("c", None, 0, None, 1),
        ("d", None, 0, d("2024-01-09"), 3),
    )
    found = changes.candidate_dates(src, known, d("2024-01-10"))
    by = lambda s: [r.event_date.day for r in found.where(f"source_id = '{s}'").orderBy("event_date").collect()]
    assert by("a") == [2, 4, 5, 6, 7, 8, 9]  # base 9; 3 is recorded; 4 has no run time
    assert by("b") == [10] and by("c") == [9, 10] and by("d") == [9, 10]


def test_changed_dates_and_second_scan(spark, tmp_path):
    profile = spark.createDataFrame(
        [("s", d("2024-01-01"), 5), ("s", d("2024-01-02"), 6), ("s", d("2024-01-03"), 7), ("s", d("2024-01-09"), 1)],
        "source_id string, event_date date, event_count bigint",
    )
    known = recorded(
        spark,
        ("s", d("2024-01-01"), 5, at(4)),
        ("s", d("2024-01-02"), 9, at(4)),
        ("s", d("2024-01-03"), 7, None),
        ("other", d("2024-01-01"), 1, at(4)),
    )
    days = lambda df: sorted(r.event_date.day for r in df.collect())
    assert days(changes.changed_dates(profile, known, d("2024-01-05"))) == [2, 3]
    assert days(changes.changed_dates(profile, known)) == [2, 3, 9]
    updated = spark.createDataFrame(
        [(d("2024-01-01"), at(5)), (d("2024-01-01"), at(3))], "event_date date, updated_timestamp timestamp_ntz"
    )
    assert days(changes.changed_dates(profile, known, d("2024-01-05"), updated)) == [1, 2, 3]
    earlier = updated.where(F.col("updated_timestamp") < F.lit(at(4)))
    assert days(changes.changed_dates(profile, known, d("2024-01-05"), earlier)) == [2, 3]

    control = ControlTables(spark, str(tmp_path))
    assert control.read("source_dates").count() == 0
    first = changes.changed_dates(profile, control.read("source_dates"))
    control.record_source_dates(first.withColumn("etl_timestamp", F.lit(at(10)).cast("timestamp_ntz")))
    assert changes.changed_dates(profile, control.read("source_dates")).count() == 0


def test_batches_group_equal_sets_of_models(spark, rows):
    pairs = [("m1", day) for day in range(1, 6)] + [("m2", 2), ("m2", 5)]
    due = spark.createDataFrame([(m, dt.date(2024, 1, x)) for m, x in pairs], "model_id string, event_date date")
    whole = changes.date_batches(due)
    shape = lambda df: sorted((tuple(r.ids), r.batch, [x.day for x in r.event_dates]) for r in df.collect())
    assert shape(whole) == [(("m1",), 0, [4, 3, 1]), (("m1", "m2"), 0, [5, 2])]
    assert shape(changes.date_batches(due, 2)) == [
        (("m1",), 0, [4, 3]),
        (("m1",), 1, [1]),
        (("m1", "m2"), 0, [5, 2]),
    ]


def test_due_dates(spark, rows):
    links = spark.createDataFrame([("s", "m"), ("s", "n")], "source_id string, model_id string")
    seen = recorded(spark, *[("s", dt.date(2024, 1, x), 1, at(10)) for x in (1, 2, 3, 4)])
    runs = spark.createDataFrame(
        [
            ("m", d("2024-01-01"), at(11), "success"),
            ("m", d("2024-01-02"), at(9), "success"),
            ("m", d("2024-01-03"), at(11), "error"),
            ("m", d("2024-01-04"), at(11), "success"),
        ],
        "model_id string, event_date date, etl_timestamp timestamp_ntz, run_status string",
    )
    tests = spark.createDataFrame(
        [("t", "m", d("2024-01-04"), at(11), "fail"), ("t", "m", d("2024-01-01"), at(2), "fail")],
        "test_id string, model_id string, event_date date, etl_timestamp timestamp_ntz, test_status string",
    )
    src = sources(spark, ("s", None, 0, d("2024-01-02"), 3))
    limits = changes.model_limits(src, links)
    assert rows(limits) == [("m", d("2024-01-02"), 3), ("n", d("2024-01-02"), 3)]
    due = changes.due_dates(links.where("model_id = 'm'"), seen, runs, tests)
    assert [r.event_date.day for r in due.orderBy("event_date").collect()] == [2, 3, 4]
    assert changes.due_dates(links, seen, runs, tests, limits).count() == 3 + 3


def test_runs_failures_and_compaction(spark, rows, tmp_path):
    control = ControlTables(spark, str(tmp_path))
    names = "model_id string, event_date date, etl_timestamp timestamp_ntz, run_message string, run_status string"
    long = "x" * 150
    control.record_model_dates(
        spark.createDataFrame(
            [
                ("m", d("2024-01-02"), at(10), long, "error"),
                ("m", d("2024-01-01"), at(10), long, "error"),
                ("m", d("2024-01-03"), at(9), "", "error"),
                ("n", d("2024-01-01"), at(1), "", "success"),
            ],
            names,
        )
    )
    stored = control.read("model_dates")
    assert rows(changes.failed_dates(stored, at(10))) == [("m", d("2024-01-01")), ("m", d("2024-01-02"))]
    assert rows(changes.failure_summary(stored, at(10))) == [("m", "error", long, "2024-01-01, 2024-01-02")]
    assert rows(changes.compaction_due(stored, at(10), 5)) == [("n", d("2024-01-01"))]
    control.record_compaction(
        spark.createDataFrame(
            [("n", d("2024-01-01"), at(10))], "model_id string, event_date date, optimize_timestamp timestamp_ntz"
        )
    )
    stored = control.read("model_dates")
    assert changes.compaction_due(stored, at(30), 5).count() == 0
    assert stored.where("model_id = 'n'").first().run_status == "success"
    control.record_model_dates(spark.createDataFrame([("n", d("2024-01-01"), at(20), "", "success")], names))
    assert rows(changes.compaction_due(control.read("model_dates"), at(20), 5)) == [("n", d("2024-01-01"))]

    control.record_test_dates(
        spark.createDataFrame(
            [("t", "m", d("2024-01-01"), at(10), "bad", "fail"), ("t", "m", d("2024-01-02"), at(10), "bad", "fail")],
            "test_id string, model_id string, event_date date, etl_timestamp timestamp_ntz, test_message string, test_status string",
        )
    )
    assert rows(changes.failed_tests(control.read("test_dates"), at(10))) == [("t", "m", "fail", "bad")]


def test_registering_a_source_again_keeps_it_active(spark, rows, tmp_path):
    control = ControlTables(spark, str(tmp_path))
    one = lambda text: spark.createDataFrame([("s", text)], "source_id string, properties string")
    control.register_sources(one("1"))
    control.register_sources(one("2").withColumn("etl_active", F.lit(True)), keep_active=False)
    control.register_sources(one("3"))
    assert rows(control.read("sources")) == [("s", "3", True)]


# --- checks ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark):
    rows = [("2024-01-01", 1, "a"), ("2024-01-01", 2, "b"), ("2024-01-02", 2, None), ("2024-01-02", None, "z")]
    df = spark.createDataFrame(rows, "x string, k int, v string")
    return df.select(F.col("x").cast("date").alias("partition_daily"), "k", "v")


def test_column_checks(spark, model, rows):
    assert checks.not_null(model, "v").count() == 1
    assert rows(checks.null_counts(model, ["k", "v", "partition_daily"])) == [("k", 1), ("v", 1)]
    assert rows(checks.unique(model, "k")) == [(2, 2)]
    assert checks.unique(model, "k", "v is not null").count() == 0
    assert rows(checks.accepted_values(model, "v", ["a", "b"])) == [("z", 1)]
    parent = spark.createDataFrame([(1,), (None,)], "id int")
    assert rows(checks.relationships(model, "k", parent, "id")) == [(2, 2)]


def test_row_count_checks(model, rows):
    grown = model.unionAll(model.where("k = 1"))
    assert rows(checks.equal_row_count(grown, model))[0][:4] == (4, 5, 1, "left")
    assert checks.equal_row_count(model, model).count() == 0
    fewer = model.where("k = 1")
    assert rows(checks.equal_row_count(fewer, model))[0][2] == -3
    assert checks.equal_row_count(fewer, model, mode="increase").count() == 0
    assert checks.equal_row_count(grown, model, "2024-01-02").count() == 0
    assert checks.equal_row_count(grown, model, join_type="inner") is None
    assert checks.equal_row_count(grown.drop("partition_daily"), model) is None
    assert checks.equal_or_lower_row_count(fewer, model).count() == 0
    assert checks.equal_or_lower_row_count(grown, model, join_type="inner").count() == 1


def test_null_sums(spark, rows):
    df = spark.createDataFrame([("2024-01-01", None), ("2024-01-02", 1.0)], "x string, v double")
    df = df.select(F.col("x").cast("date").alias("partition_daily"), "v")
    assert rows(checks.no_null_aggregates(df, "v")) == [(d("2024-01-01"),)]
    assert checks.no_null_aggregates(df, "v", "2024-01-02").count() == 0


def test_checks_follow_the_shape_of_a_model():
    assert checks_for(["inner", "left"], ["x_sum"]) == [
        Check("equal_row_count", join_type="left"),
        Check("no_null_aggregates", column="x_sum"),
    ]
    assert checks_for(["inner"]) == [Check("equal_or_lower_row_count", join_type="inner")]
    assert checks_for([]) == []
    assert checks_for(["inner", "left"], equal_for=["left"], equal_or_lower_for=["inner"]) == [
        Check("equal_row_count", join_type="left"),
        Check("equal_or_lower_row_count", join_type="inner"),
    ]


def test_freshness(spark):
    df = spark.createDataFrame([(at(1, 0),), (at(1, 12),)], "t timestamp_ntz")
    status = lambda **k: checks.freshness(df, "t", at(2, 0), **k).first().status
    assert status() == "pass"
    assert status(warn_after=(12, "hour")) == "pass" and status(warn_after=(11, "hour")) == "warn"
    assert status(warn_after=(1, "hour"), error_after=(600, "minute")) == "error"
    assert status(error_after=(1, "day"), where="t < timestamp_ntz'2024-01-01 01:00:00'") == "pass"
    assert status(error_after=(1, "day"), where="false") == "error"


def test_named_checks_run_together(model, rows):
    result = run_checks(
        model,
        {
            "nulls": lambda df: checks.not_null(df, "k"),
            "fine": lambda df: df.where("false"),
            "n/a": lambda df: checks.equal_row_count(df, df, join_type="inner"),
        },
    )
    assert rows(result) == [("fine", 0, "pass"), ("n/a", None, "skip"), ("nulls", 1, "fail")]


def test_messages_are_told_apart_as_a_whole(spark):
    rows = [("m", d("2024-01-01"), "x" * 100 + "a"), ("m", d("2024-01-02"), "x" * 100 + "b")]
    runs = spark.createDataFrame(rows, "model_id string, event_date date, run_message string")
    runs = runs.selectExpr("*", "'error' as run_status", "timestamp_ntz'2024-02-01' as etl_timestamp")
    found = changes.failure_summary(runs, F.expr("timestamp_ntz'2024-02-01'"), characters=5)
    assert [tuple(r) for r in found.orderBy("event_dates").collect()] == [
        ("m", "error", "xxxxx", "2024-01-01"),
        ("m", "error", "xxxxx", "2024-01-02"),
    ]


def test_parallel_records_lose_nothing(spark, tmp_path, rows):
    """Eight tasks record dates of one model at the same time, others its compactions."""
    names = "model_id string, event_date date, run_status string, run_rows bigint"
    sessions = [spark.newSession() for _ in range(8)]

    def run(k):
        control = ControlTables(sessions[k], str(tmp_path))
        days = [dt.date(2024, 1, 1 + k), dt.date(2024, 2, 1)]
        control.record_model_dates(sessions[k].createDataFrame([("m", x, "success", k) for x in days], names))
        done = sessions[k].createDataFrame([("m", days[0], at(k + 1))], "model_id string, event_date date, optimize_timestamp timestamp_ntz")
        control.record_compaction(done)

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(run, range(8)))
    control = ControlTables(spark, str(tmp_path))
    state = {r["event_date"]: r for r in control.read("model_dates").collect()}
    assert len(state) == 9 and state[dt.date(2024, 2, 1)]["run_rows"] in range(8)
    for k in range(8):
        row = state[dt.date(2024, 1, 1 + k)]
        assert (row["run_rows"], row["run_status"], row["optimize_timestamp"]) == (k, "success", at(k + 1))


def test_compaction_of_records_keeps_the_state(spark, tmp_path, rows):
    control = ControlTables(spark, str(tmp_path))
    names = "model_id string, event_date date, run_status string, run_rows bigint"
    for k in range(4):
        control.record_model_dates(spark.createDataFrame([("m", d("2024-01-01"), "error", k), (f"m{k}", d("2024-01-01"), "success", k)], names))
        control.record_compaction(
            spark.createDataFrame([("m", d("2024-01-01"), at(k + 1))], "model_id string, event_date date, optimize_timestamp timestamp_ntz")
        )
    before = rows(control.read("model_dates"))
    old = control.compact("model_dates", forget=False)
    assert len(old) == 8 and rows(control.read("model_dates")) == before  # old and new folders together
    control.record_model_dates(spark.createDataFrame([("m", d("2024-01-01"), "success", 9)], names))
    control.forget(old)
    after = rows(control.read("model_dates").where("model_id <> 'm'"))
    assert after == [r for r in before if r[0] != "m"]
    last = control.read("model_dates").where("model_id = 'm'").first()
    assert (last["run_rows"], last["optimize_timestamp"]) == (9, at(4))
    assert len(control._folders("model_dates")) == 2 and control._records("model_dates").count() < 9 + 4
    assert control.compact("sources") == []
    with pytest.raises(ValueError):
        control.record_model_dates(spark.createDataFrame([("m", d("2024-01-01"), "a", 1), ("m", d("2024-01-01"), "b", 2)], names))
    assert len(control._folders("model_dates")) == 2


def test_counted_checks_share_one_read(spark, tmp_path, rows):
    path = str(tmp_path / "model")
    made = spark.range(100).selectExpr("id", "nullif(id % 10, 3) AS v", "date'2024-01-01' AS partition_daily")
    made.write.parquet(path)
    df = spark.read.parquet(path)
    wanted = {
        "a": checks.no_nulls("v"),
        "b": checks.no_nulls("v", "id > 50"),
        "c": checks.only_values("v", [1, 2]),
        "d": checks.rows_where("id >= 98"),
        "e": checks.same_row_count(made.limit(99), "2024-01-01"),
        "f": checks.no_more_rows(made, "2024-01-01"),
        "g": checks.same_row_count(made, join_type="inner"),
    }
    result = run_checks(df, wanted)
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    assert rows(result) == [
        ("a", 10, "fail"), ("b", 5, "fail"), ("c", 7, "fail"), ("d", 2, "fail"), ("e", 1, "fail"), ("f", 0, "pass"), ("g", None, "skip"),
    ]
    for name, check in wanted.items():  # each alone says the same
        failing = check(df)
        alone = None if failing is None else failing.count()
        assert (name, alone) in [(r[0], r[1]) for r in result.collect()]


@pytest.mark.parametrize("strategy", ["full_refresh", "append", "overwrite_existing_partitions", "delete+insert", "merge"])
def test_a_write_returns_its_checks(spark, tmp_path, rows, strategy):
    table = Table(str(tmp_path / "t"), ("partition_daily",))
    model = spark.range(100).selectExpr("id", "nullif(id % 10, 3) AS v", "date'2024-01-01' AS partition_daily")
    wanted = {"a": checks.no_nulls("v"), "b": checks.rows_where("id < 0"), "c": checks.only_values("v", [1, 2])}
    for _ in range(2):
        found = write_incremental(model, table, strategy, unique_key=["id"] if strategy == "merge" else None, checks=wanted)
        assert rows(found) == [("a", 10, "fail"), ("b", 0, "pass"), ("c", 70, "fail")]
    with pytest.raises(ValueError):
        write_incremental(model, table, strategy, checks={"n": checks.same_row_count(model)})
    assert table.read(spark, model.schema).count() == (200 if strategy == "append" else 100)
