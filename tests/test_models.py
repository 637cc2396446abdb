import datetime as dt

import pytest
from pyspark.sql import functions as F

from lamella import (
    Join,
    all_from,
    all_true,
    any_true,
    canonical_order,
    compare,
    dim,
    dims,
    dims_from,
    exists,
    facts,
    facts_from,
    fct,
    grain,
    is_in,
    join_models,
    lookback_model,
    not_exists,
    not_in,
    outer,
    rollup_model,
    select_model,
    union_models,
    unnest_model,
    with_roles,
)
from lamella.operators.aggregate import agg_name, is_aggregate_expr, suffix_agg


@pytest.fixture(scope="module")
def base(spark):
    rows = [("acme", "eu", 10.0), ("acme", "us", 5.0), ("zed", "eu", 1.0), (None, "eu", 2.0)]
    return with_roles(spark.createDataFrame(rows, "tenant string, region string, revenue double"), facts=["revenue"])


@pytest.fixture(scope="module")
def other(spark):
    rows = [("acme", "web", "eu", 3.0), ("zed", "web", "us", 4.0), (None, "web", "eu", 9.0)]
    df = spark.createDataFrame(rows, "tenant string, service string, region string, cost double")
    return with_roles(df, facts=["cost"])


def test_roles_default_to_dimension_and_survive(base):
    assert dims(base) == ["tenant", "region"] and facts(base) == ["revenue"]
    kept = select_model(base, [all_from()])
    assert facts(kept) == ["revenue"]
    assert facts(select_model(base, ["revenue"])) == []  # a bare name is a dimension
    assert facts(select_model(base, ["tenant", fct("revenue", agg="sum")])) == ["revenue_sum"]
    with pytest.raises(ValueError):
        with_roles(base, facts=["nope"])


def test_bulk_selection_and_order(base):
    assert select_model(base, [dims_from(exclude=["region"]), facts_from()]).columns == ["revenue", "tenant"]
    assert select_model(base, [all_from(include=["region"])]).columns == ["region"]
    assert canonical_order(["z", "partition_daily", "a", "partition_monthly"]) == [
        "a",
        "z",
        "partition_monthly",
        "partition_daily",
    ]


def test_first_of_two_equal_names_wins(base, rows):
    out = select_model(base, [dim("tenant", "upper(tenant)"), all_from(include=["tenant"])])
    assert ("ACME",) in rows(out) and out.columns == ["tenant"]


def test_aggregate_names():
    assert agg_name("x", "sum") == "x_sum" and agg_name("x_sum", "sum") == "x_sum"
    assert agg_name("x_sum", "sum", True) == "x_sum_sum" and agg_name("x_sum", "max") == "x_sum_max"
    assert suffix_agg("x_count") == "count" and suffix_agg("count") is None and suffix_agg("x_avg") is None
    with pytest.raises(ValueError):
        agg_name("x", "avg")


def test_aggregate_expressions_are_recognised(spark):
    df = spark.createDataFrame([], "x int, y int, z int")
    assert is_aggregate_expr(df, "COUNT(*)") and is_aggregate_expr(df, "1 + sum( x )")
    assert not is_aggregate_expr(df, "sum(coalesce(x, 0)) over (partition by y)")
    assert is_aggregate_expr(df, "avg(x)") and is_aggregate_expr(df, F.max("z") + 1)
    assert not is_aggregate_expr(df, "abs(x)") and not is_aggregate_expr(df, None) and not is_aggregate_expr(df, "1")


def test_implicit_grouping_and_bare_facts(base, rows):
    out = select_model(base, ["region", fct("revenue", aggs=["sum", "count"])])
    assert rows(out) == [("eu", 3, 13.0), ("us", 1, 5.0)]
    with pytest.raises(ValueError, match="revenue"):
        select_model(base, ["region", fct("revenue"), fct("n", "tenant", agg="count")])
    with pytest.raises(ValueError):
        select_model(base, ["region"], having="count(*) > 1")


def test_count_rolled_up_twice_stays_a_count(spark, rows):
    times = ["2024-01-01 00:10:00", "2024-01-01 00:20:00", "2024-01-01 05:00:00", "2024-02-01 00:00:00"]
    df = spark.createDataFrame([(t, 1.0) for t in times], "t string, v double")
    df = df.select(F.col("t").cast("timestamp_ntz").alias("datetime"), "v")
    hourly = select_model(df, [grain("hour"), fct("v", aggs=["count", "sum"])])
    monthly = rollup_model(rollup_model(hourly, "day"), "month")
    assert rows(monthly) == [(dt.datetime(2024, 1, 1), 3, 3.0), (dt.datetime(2024, 2, 1), 1, 1.0)]
    # Cutting to the grain a model already has leaves the time alone.
    assert monthly.schema["datetime"].metadata["interval"] == "month"


def test_rollup_keeps_measures_only_and_honours_rules(spark, rows):
    df = spark.createDataFrame([(1, 2, 3.0, 9.0)], "k int, order_count int, price_max double, note double")
    df = with_roles(df.withColumn("datetime", F.expr("timestamp_ntz'2024-05-06 07:08:09'")), ["order_count", "price_max", "note"])
    assert rollup_model(df, "year").columns == ["datetime", "k", "order_count", "price_max"]
    assert rollup_model(df, "year", merge_rules={"order_count": None}).columns == ["datetime", "k", "price_max"]


def test_join_on_shared_dims(base, other, rows):
    out = join_models(("a", base), [Join(other, "b", "dims")], ["tenant", fct("revenue"), fct("cost", side="b")])
    assert rows(out) == [(3.0, 10.0, "acme")]  # null never equals null
    with pytest.raises(ValueError, match="share no dimension"):
        join_models(("a", base), [Join(other.select("service"), "b", "dims")])


def test_full_join_forms_agree(base, other, rows):
    pick = ["tenant", dim("theirs", "b.tenant"), fct("revenue"), fct("cost", side="b")]
    plain = join_models(("a", base), [Join(other, "b", ["tenant"], "full", skewed=False)], pick)
    split = join_models(("a", base), [Join(other, "b", ["tenant"], "full")], pick)
    assert rows(plain) == rows(split) and plain.count() == 5


def test_join_arguments_are_checked(base, other):
    with pytest.raises(ValueError):
        Join(other, "b", [], "inner")
    with pytest.raises(ValueError):
        Join(other, "b", ["tenant"], "cross")
    with pytest.raises(ValueError):
        Join(other, "b", ["tenant"], "asof")
    with pytest.raises(ValueError, match="twice"):
        join_models(("a", base), [Join(other, "a", ["tenant"])])


def test_nested_conditions_keep_their_precedence(spark, rows):
    df = spark.createDataFrame([(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)], "a int, b int, c int")
    out = df.where(all_true("a = 1 or b = 1", None, "", any_true("c = 1", all_true("a = 1", "b = 1"))))
    assert rows(out) == [(0, 1, 1), (1, 0, 1), (1, 1, 0), (1, 1, 1)]
    assert all_true() is None and any_true("", None) is None


@pytest.mark.parametrize(
    "listed, kept", [([1, None], []), ([], [None, 1, 2]), ([1], [2]), ([None], []), ([3], [1, 2])]
)
def test_not_in_null_rules(spark, listed, kept):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    sub = spark.createDataFrame([(v,) for v in listed], "v int")
    assert sorted((r.k for r in df.where(not_in("k", sub, "v")).collect()), key=repr) == sorted(kept, key=repr)


def test_subqueries(spark, rows):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, None)], "k int, v int")
    sub = spark.createDataFrame([(1, 4), (2, 20)], "k2 int, w int")
    assert rows(df.where(is_in("k", sub, "k2", "w > 10")).select("k")) == [(2,)]
    smaller = all_true(F.col("k2") == outer("k"), F.col("w") < outer("v"))
    assert rows(df.where(exists(sub, smaller)).select("k")) == [(1,)]
    assert rows(df.where(not_exists(sub, smaller)).select("k")) == [(2,), (3,)]
    assert rows(df.where(compare("v", "gte", sub, "max(w) / 4")).select("k")) == [(1,), (2,)]
    with pytest.raises(ValueError):
        compare("v", "like", sub, "w")


def test_large_not_in_does_not_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df, sub = spark.range(100).toDF("k"), spark.range(50).toDF("v")
        plan = df.where(not_in("k", sub, "v"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Broadcast" not in plan


def test_unnest(spark, rows):
    df = spark.createDataFrame(
        [(1, [10, 11], {"a": 1}), (2, [], {}), (3, None, None)], "id int, xs array<int>, m map<string,int>"
    )
    assert rows(unnest_model(df, "xs", ["x"], ["id", "x"])) == [(1, 10), (1, 11)]
    assert rows(unnest_model(df, "m", ["key", "value"], ["id", "key", "value"])) == [(1, "a", 1)]
    texts = spark.createDataFrame([(1, '[{"sku":"s","qty":2}]'), (2, "[]"), (3, None)], "id int, j string")
    out = unnest_model(texts, "j", ["sku", "qty"], ["id", "sku", "qty"], json_schema="array<struct<sku:string,qty:int>>")
    assert rows(out) == [(1, 2, "s")]
    with pytest.raises(ValueError):
        unnest_model(df, "id", ["x"])
    with pytest.raises(ValueError):
        unnest_model(df, "xs", ["id"])


def test_union(spark, rows):
    a = with_roles(spark.createDataFrame([(1, 2.0)], "k int, v double"), ["v"])
    b = spark.createDataFrame([(3.0, 4, "x")], "v double, k int, more string")
    both = union_models([a, b])
    assert rows(both) == [(1, 2.0), (4, 3.0)] and facts(both) == ["v"]
    with pytest.raises(Exception):
        union_models([b, a]).collect()
    with pytest.raises(ValueError):
        union_models([])


def _daily(spark, days):
    df = spark.createDataFrame([(x, k, v) for x, k, v in days], "x string, k string, v double")
    return df.select(F.col("x").cast("date").alias("partition_daily"), "k", "v")


def test_lookback_window_edges(spark, rows):
    df = _daily(spark, [("2024-02-27", "a", 1.0), ("2024-02-28", "a", 2.0), ("2024-03-01", "b", 4.0)])
    pick = ["k", fct("v", agg="sum")]
    day = dt.date
    # Two days back from 1 March of a leap year reaches 28 February.
    assert rows(lookback_model(df, "2024-03-01", 2, pick)) == [
        ("a", 2.0, day(2024, 3, 1)),
        ("b", 4.0, day(2024, 3, 1)),
    ]
    assert rows(lookback_model(df, "2024-03-01", 2, pick, exclude_event_date=True)) == [("a", 2.0, day(2024, 3, 1))]
    # A date without rows of its own still has its window; a repeated date counts once.
    assert rows(lookback_model(df, "2024-02-29,2024-02-29", 1, pick)) == [("a", 2.0, day(2024, 2, 29))]
    assert lookback_model(df, "2024-03-01", 0, pick, exclude_event_date=True).count() == 0


def test_lookback_with_and_without_partial_sums(spark, rows):
    days = [(f"2024-01-{i % 28 + 1:02d}", "abc"[i % 3], float(i % 7)) for i in range(300)]
    df = _daily(spark, days)
    pick = ["k", fct("v", aggs=["sum", "count", "min", "max"])]
    args = (df, "2024-01-10~2024-01-20", 6, pick)
    assert rows(lookback_model(*args)) == rows(lookback_model(*args, pre_aggregate=False))


def test_lookback_plan_has_no_join(spark):
    df = _daily(spark, [("2024-01-01", "a", 1.0)])
    plan = lookback_model(df, "2024-01-03", 7, ["k", fct("v", agg="sum")])._jdf.queryExecution().executedPlan()
    assert "Join" not in plan.toString()


def test_order_puts_nulls_last(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "v int")
    values = lambda order, **k: [r.v for r in select_model(df, ["v"], order_by=order, **k).collect()]
    assert values([("v", "desc")]) == [3, 1, None] and values("v") == [1, 3, None]
    assert values("v", offset=1, limit=1) == [3]
    with pytest.raises(ValueError):
        values("v", limit=0)
    with pytest.raises(ValueError):
        values([("v", "down")])


def test_time_columns_come_along(spark):
    df = spark.createDataFrame([(1, 1.0)], "k int, v double").selectExpr(
        "k",
        "v",
        "timestamp_ntz'2024-01-02 03:04:05' AS datetime",
        "date'2024-01-02' AS partition_daily",
        "date'2024-01-01' AS partition_monthly",
        "1 AS source_row_count",
    )
    assert select_model(df, ["k"]).columns == [
        "datetime",
        "k",
        "source_row_count",
        "partition_monthly",
        "partition_daily",
    ]
    assert select_model(df, ["k", grain("month"), fct("v", agg="sum")]).columns == [
        "datetime",
        "k",
        "source_row_count",
        "v_sum",
        "partition_monthly",
    ]
    assert select_model(df, ["k"], row_count=False, partition_columns=False).columns == ["datetime", "k"]
    named = select_model(df, ["k", grain("day")], inherit_time=False)
    assert "partition_daily" not in named.columns


def test_only_different_rows_are_repeated_for_a_lookback(spark):
    rows = spark.createDataFrame([("a", 1)] * 5 + [("b", 2)], "kind string, user int")
    rows = rows.withColumn("partition_daily", F.expr("date'2024-01-02'"))
    users = fct("users", "count(distinct user)")
    out = lookback_model(rows, "2024-01-02~2024-01-04", 2, ["kind", users], distinct_on=["user"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Aggregate")  # rows are reduced below the repetition
    assert sorted((r["kind"], r["users"]) for r in out.collect()) == [("a", 1)] * 3 + [("b", 1)] * 3
