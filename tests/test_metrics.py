import datetime as dt
import math
import struct

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamella import (
    EventTime,
    Metric,
    PartitionPredicate,
    SourceSpec,
    Tracking,
    describe_table,
    fct,
    grain,
    in_the_past,
    metric_query,
    read_seed,
    read_table,
    register_macro,
    rollup_model,
    select_model,
    stage_source,
    standard_metric,
    time_interval,
)
from lamella.functions import scalars as S
from lamella.operators.percentile import exact_percentiles, ordered_bits
from lamella.plans.metrics import INTERVALS, default_window, equals_text, metric_time_column


def test_standard_metrics_fit_their_column(spark):
    assert standard_metric("value_sum", "count") is None
    assert standard_metric("value", "max") is None
    assert standard_metric("value", "distinctcount") is None
    assert standard_metric("value_sum", "p50") is None


def test_standard_metrics_of_stored_measures(spark, rows):
    assert standard_metric("value_sum", "sum").name == "metric_value_sum"
    assert standard_metric("value_count", "count").kind == "sum"
    assert standard_metric("value", "count", agg="count").kind == "count"
    df = spark.createDataFrame([("a", 6.0, 3), ("a", 4.0, 1), ("b", 0.0, 0)], "k string, v_sum double, v_count int")
    assert rows(metric_query(df, ["k"], [standard_metric("v", "avg")])) == [("a", 2.5), ("b", 0.0)]
    with pytest.raises(ValueError):
        metric_query(df, ["k"], [None])
    with pytest.raises(ValueError):
        Metric("x", "mode")


def test_sketches_stay_within_their_bounds_through_rollups(spark):
    df = spark.range(200_000).selectExpr(
        "id % 20000 AS who",
        "cast(id % 1000 as double) AS v",
        "timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id % 700 as int)) AS datetime",
    )
    hourly = select_model(df, [grain("hour"), fct("who", agg="hll"), fct("v", agg="tdigest")])
    monthly = rollup_model(rollup_model(hourly, "day"), "month")
    names = ["p50", "p90", "p95", "p98"]
    read = metric_query(
        monthly,
        [],
        [standard_metric("who_hll", "distinctcount", name="who")]
        + [standard_metric("v_tdigest", n, name=n) for n in names],
    ).first()
    assert abs(read.who - 20_000) < 20_000 * 0.05
    for name in names:
        assert abs(read[name] - float(name[1:]) * 10) < 30, name


NUMBERS = st.one_of(
    st.none(), st.integers(-20, 20).map(float), st.floats(allow_nan=False, allow_infinity=False, width=64).filter(lambda x: abs(x) < 1e150)
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(NUMBERS, min_size=1, max_size=60))
def test_percentiles_are_exact(spark, values):
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)], "k int, v double")
    wanted = {"low": 0.1, "mid": 0.5, "high": 1.0}
    found = {r.k: r for r in exact_percentiles(df, ["k"], F.col("v"), wanted).collect()}
    for k in (0, 1):
        group = [v for i, v in enumerate(values) if i % 2 == k and v is not None]
        if not group:
            assert k not in found
            continue
        for name, q in wanted.items():
            assert found[k][name] == pytest.approx(np.quantile(group, q), rel=1e-12, abs=1e-300), (name, group)


def test_bits_are_in_the_order_of_the_values(spark):
    edges = [0.0, -0.0, 5e-324, 1e-310, 2.0**-1022, 1.0, 1.0 - 2**-53, 1.0 + 2**-52, 1.7976931348623157e308, math.inf, math.nan]
    powers = [2.0**k for k in range(-1074, 1024, 3)]
    near = [math.nextafter(x, y) for x in powers for y in (0, math.inf)]
    values = edges + [-x for x in edges[:-1]] + powers + near + [-x for x in near] + np.random.default_rng(1).normal(size=500).tolist()
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", ordered_bits(F.col("v")).alias("bits"))
    for r in df.collect():
        (own,) = struct.unpack("<q", struct.pack("<d", abs(r.v)))
        assert r.bits == (2047 * 2**52 + 1 if math.isnan(r.v) else -own if r.v < 0 else own), r


def test_percentiles_of_a_million_groups(spark):
    df = spark.range(2_500_000).selectExpr("id % 1000000 AS g", "cast(xxhash64(id) % 100000 AS double) / 7 AS v")
    mine = exact_percentiles(df, ["g"], F.col("v"), {"median": 0.5, "p95": 0.95})
    theirs = df.groupBy("g").agg(F.median("v").alias("m"), F.percentile("v", 0.95).alias("p"))
    off = F.coalesce((F.abs(F.col("median") - F.col("m")) > 1e-6) | (F.abs(F.col("p95") - F.col("p")) > 1e-6), F.lit(True))
    assert mine.join(theirs, "g", "right").agg(F.count("*"), F.sum(off.cast("int"))).first()[:] == (1_000_000, 0)


def test_endless_values_have_percentiles(spark):
    rows = [("a", math.inf), ("a", math.inf), ("b", -math.inf), ("b", 1.0), ("b", 2.0), ("c", math.nan), ("c", 3.0), ("c", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    found = {r.k: (r.low, r.mid) for r in exact_percentiles(df, ["k"], F.col("v"), {"low": 0.0, "mid": 0.5}).collect()}
    assert found == {"a": (math.inf, math.inf), "b": (-math.inf, 1.0), "c": (3.0, 4.0)}


def test_percentiles_read_their_values_once(spark, tmp_path):
    path = str(tmp_path / "values")
    spark.range(20_000).selectExpr("id % 3 AS k", "cast(id AS double) AS v").write.parquet(path)
    found = exact_percentiles(spark.read.parquet(path), ["k"], F.col("v"), {"median": 0.5})
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup()
    found = exact_percentiles(spark.read.parquet(path), ["k"], F.col("v"), {"median": 0.5})
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - len(jobs) <= 1  # the schema is read, nothing else
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") >= 3 and " Sort [v" not in plan


def test_percentiles_of_one_hot_group(spark):
    df = spark.range(50_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE cast(id % 50 as string) END AS k", "pow(id % 9973, 1.5) AS v")
    mine = metric_query(df, ["k"], [Metric("m", "median", "v"), Metric("p", "percentile", "v", 99)])
    theirs = df.groupBy("k").agg(F.median("v").alias("m2"), F.percentile("v", 0.99).alias("p2"))
    off = mine.join(theirs, "k").where("abs(m - m2) > 1e-6 or abs(p - p2) > 1e-6").count()
    assert off == 0 and mine.count() == theirs.count()


def test_null_groups_keep_their_percentile(spark, rows):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None)], "k string, v double")
    out = metric_query(df, ["k"], [Metric("n", "count"), Metric("m", "median", "v")])
    assert rows(out) == [("a", 1, None), (None, 2, 2.0)]


def test_intervals_and_windows(spark, rows):
    df = spark.createDataFrame([(dt.datetime(2024, 12, 30, 13, 5),)], "t timestamp_ntz")
    read = df.select(*[time_interval("t", i).alias(i) for i in INTERVALS]).first()
    assert read.RAW == dt.datetime(2024, 12, 30, 13, 5) and read.HOUR == dt.datetime(2024, 12, 30, 13)
    assert read.WEEK == dt.date(2024, 12, 30) and read.QUARTER == dt.date(2024, 10, 1)
    assert (read.DAY_OF_WEEK_INDEX, read.DAY_OF_WEEK_NAME, read.WEEK_NUM) == (0, "Monday", 1)
    assert (read.MONTH_NAME, read.QUARTER_NAME, read.DAY_OF_YEAR_NUM) == ("December", "Q4", 365)
    with pytest.raises(ValueError):
        time_interval("t", "DECADE")
    asof = dt.date(2024, 12, 31)
    assert df.where(in_the_past(F.to_date("t"), 1, "days", asof)).count() == 1
    assert df.where(in_the_past(F.to_date("t"), 2, "months", dt.date(2024, 12, 29))).count() == 0
    with pytest.raises(ValueError):
        in_the_past("t", 1, "weeks")
    both = df.selectExpr("t AS partition_monthly", "t AS partition_daily")
    assert default_window(both) == (14, "days") and default_window(both.drop("partition_daily")) == (2, "months")
    assert default_window(df) is None and metric_time_column(both) == "partition_daily"
    assert metric_time_column(df) == "datetime"


def test_text_matching(spark):
    df = spark.createDataFrame([("Click",), ("VIEW",)], "e string")
    assert df.where(equals_text("e", "click")).count() == 0
    assert df.where(equals_text("e", "click", case_sensitive=False)).count() == 1


# --- sources and scalars --------------------------------------------------------------------


def test_seed_files(spark, tmp_path):
    path = tmp_path / "raw_products.csv"
    path.write_text('sku,name,description\nJAF-001,nutellaphone,"nutella, ""and"" banana"\nJAF-002,"two\nlines",\n')
    df = read_seed(spark, str(path))
    assert df.columns == ["sku", "name", "description"] and df.count() == 2
    first = df.orderBy("sku").first()
    assert first.description == 'nutella, "and" banana'
    typed = read_seed(spark, str(path), "sku string, name string, description string")
    assert typed.orderBy(F.desc("sku")).first().name == "two\nlines"


def test_tables_are_read_and_described(spark, tmp_path):
    df = spark.range(3).select(F.col("id").alias("k", metadata={"comment": "the key"}))
    df.write.parquet(str(tmp_path / "t"))
    assert read_table(spark, str(tmp_path / "t")).count() == 3
    df.createOrReplaceTempView("keys_of_t")
    assert read_table(spark, "keys_of_t").count() == 3
    assert tuple(describe_table(df).first()) == ("k", "bigint", False, "the key")


def test_specs_are_merged_field_by_field():
    wide = SourceSpec(event_time=EventTime("ts", "day", True), tracking=Tracking(lookback_days=3))
    table = SourceSpec("t", EventTime("ts2"), tracking=Tracking(date_delay=1))
    spec = wide.override(table)
    assert spec.source_id == "t" and spec.event_time == EventTime("ts2", "day", True)
    assert spec.tracking == Tracking(lookback_days=3, date_delay=1)
    with pytest.raises(ValueError):
        PartitionPredicate("x", "like", "y")


def test_staging_does_not_depend_on_the_time_zone(spark, rows):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 2, 30), "a")], "ts timestamp_ntz, k string")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        # This local time does not exist in that zone.
        staged = stage_source(df, SourceSpec("s", EventTime("ts")), ["k"]).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert staged.partition_hourly == dt.datetime(2024, 3, 10, 2) and staged.datetime.minute == 30


def test_static_filter_prunes_files(spark, tmp_path):
    df = spark.range(4).selectExpr("id", "date_add(date'2024-01-01', cast(id as int)) AS p")
    df.write.partitionBy("p").parquet(str(tmp_path / "t"))
    spec = SourceSpec("s", partitions=(PartitionPredicate("p", "gte", "2024-01-03"),), row_count=False)
    out = stage_source(spark.read.parquet(str(tmp_path / "t")), spec)
    assert out.count() == 2 and "PartitionFilters: [isnotnull(p" in out._jdf.queryExecution().toString()


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(S.split_text(F.lit("a.b|c"), ".")) == ["a", "b|c"]
    assert value(S.element(F.array(F.lit(5)), 2)) is None
    assert value(S.cardinality(F.lit(None).cast("array<int>"))) is None
    assert value(S.greatest(F.lit(1), F.lit(None))) is None and value(S.least(F.lit(1), F.lit(2))) == 1
    assert value(S.to_integer(F.lit(2.5))) == 3 and value(S.to_integer(F.lit(-2.5))) == -3
    assert value(S.int_div(F.lit(7), F.lit(2))) == 3 and value(S.int_div(F.lit(-7), F.lit(2))) == -3
    assert value(S.day_of_week(F.lit(dt.date(2024, 1, 7)))) == 7
    assert value(S.format_date(F.lit(dt.date(2024, 1, 7)), "%Y-%m-%d")) == "2024-01-07"
    with pytest.raises(ValueError):
        S.format_date(F.lit("x"), "%Q")
    with pytest.raises(ValueError):
        S.date_plus("hour", 1, F.lit(dt.date(2024, 1, 7)))
    register_macro(spark, "twice", {"n": "int"}, "n * 2", "int")
    assert value(F.expr("twice(21)")) == 42
