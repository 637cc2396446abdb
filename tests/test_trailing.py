"""Long trailing windows against brute force, and how many rows they make."""

import datetime as dt
import math
import random
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamella import fct, lookback_distinct_model, lookback_model
from lamella.operators import trailing

DAY0 = dt.date(2023, 1, 1)
SCHEMA = "partition_daily date, shop string, units long, price decimal(20,8), weight double, buyer string"


def day(k):
    return DAY0 + dt.timedelta(days=k)


def rows(n, spread, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        price = None if r.random() < 0.1 else Decimal(r.randrange(-(10**9), 10**9)) / Decimal(10**8)
        weight = r.choice([None, r.uniform(-5, 5), r.uniform(0, 1), 1e17])
        units = r.choice([None, r.randrange(-5, 9)])
        out.append((day(r.randrange(spread)), r.choice(["a", "b", None]), units, price, weight, r.choice([None, "x", "y", "z", "w"])))
    return out


def total(values):
    kept = [v for v in values if v is not None]
    return sum(kept[1:], kept[0]) if kept else None


def windows(data, dates, days, first):
    for shop in {r[1] for r in data}:
        for e in dates:
            seen = [r for r in data if r[1] == shop and e - dt.timedelta(days=days) <= r[0] <= e - dt.timedelta(days=first)]
            if seen:
                yield shop, e, seen


DENSE, SPARSE = [day(k) for k in range(0, 130)], [day(k) for k in (3, 4, 50, 51, 90, 200, 201, 400)] + [day(k) for k in range(60, 85)]


@pytest.mark.parametrize("dates", [DENSE, SPARSE])
@pytest.mark.parametrize("days, exclusive", [(40, False), (63, True), (17, True)])
def test_exact_measures_enter_and_leave(spark, dates, days, exclusive):
    data = rows(150, 120, days)
    df = spark.createDataFrame(data, SCHEMA)
    picked = ["shop", fct("units", aggs=["sum", "count"]), fct("price", agg="sum")]
    found = lookback_model(df, dates, days, picked, exclude_event_date=exclusive)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "swept" in plan and "Join" not in plan
    want = {
        (shop, e): (total(r[2] for r in seen), sum(r[2] is not None for r in seen), total(r[3] for r in seen))
        for shop, e, seen in windows(data, dates, days, int(exclusive))
    }
    got = {(r["shop"], r["partition_daily"]): (r["units_sum"], r["units_count"], r["price_sum"]) for r in found.collect()}
    assert got == want


@pytest.mark.parametrize("dates", [DENSE, SPARSE])
@pytest.mark.parametrize("days, exclusive", [(40, False), (63, True)])
def test_other_measures_by_blocks(spark, dates, days, exclusive):
    data = rows(150, 120, days)
    df = spark.createDataFrame(data, SCHEMA)
    picked = ["shop", fct("weight", aggs=["sum", "min", "max"]), fct("units", agg="count"), fct("buyer", agg="hll")]
    found = lookback_model(df, dates, days, picked, exclude_event_date=exclusive)
    found = found.withColumn("buyers", F.hll_sketch_estimate("buyer_hll")).collect()
    want = {(shop, e): seen for shop, e, seen in windows(data, dates, days, int(exclusive))}
    assert {(r["shop"], r["partition_daily"]) for r in found} == set(want)
    for r in found:
        seen = want[r["shop"], r["partition_daily"]]
        weights = [x[4] for x in seen if x[4] is not None]
        assert r["units_count"] == sum(x[2] is not None for x in seen)
        assert r["buyers"] == len({x[5] for x in seen} - {None})  # few values are counted exactly
        assert (r["weight_min"], r["weight_max"]) == ((min(weights), max(weights)) if weights else (None, None))
        # A large value that has left the window takes no small ones with it.
        assert (r["weight_sum"] is None) == (not weights)
        assert not weights or math.isclose(r["weight_sum"], math.fsum(weights), rel_tol=1e-9, abs_tol=1e-6 if 1e17 not in weights else 64)


def test_infinite_values_leave_with_their_day(spark):
    data = [(day(0), "a", 1, None, math.inf, None), (day(30), "a", 1, None, 2.0, None), (day(31), "a", None, None, math.nan, None)]
    df = spark.createDataFrame(data, SCHEMA)
    found = lookback_model(df, [day(k) for k in range(70)], 20, ["shop", fct("weight", agg="sum")]).collect()
    got = {r["partition_daily"]: r["weight_sum"] for r in found}
    assert got[day(20)] == math.inf and day(21) not in got and got[day(30)] == 2.0 and math.isnan(got[day(40)])
    assert day(51) in got and day(52) not in got


@pytest.mark.parametrize("dates", [DENSE, SPARSE])
@pytest.mark.parametrize("days, exclusive", [(40, False), (63, True), (0, False)])
def test_distinct_counts(spark, dates, days, exclusive):
    data = rows(150, 120, days)
    df = spark.createDataFrame(data, SCHEMA)
    counted = {"buyers": "buyer", "units_seen": "units"}
    found = lookback_distinct_model(df, dates, days, ["shop"], counted, exclude_event_date=exclusive)
    got = {(r["shop"], r["partition_daily"]): (r["buyers"], r["units_seen"]) for r in found.collect()}
    want = {
        (shop, e): (len({r[5] for r in seen} - {None}), len({r[2] for r in seen} - {None}))
        for shop, e, seen in windows(data, dates, days, int(exclusive))
    }
    assert got == want
    everywhere = lookback_distinct_model(df, dates, days, [], {"buyers": "buyer"}, exclude_event_date=exclusive)
    assert everywhere.count() == len({e for _, e, _ in windows(data, dates, days, int(exclusive))})


def test_an_interval_is_two_rows(spark):
    data = [(day(k), "a", None, None, None, "x") for k in range(0, 200)] + [(day(k), "a", None, None, None, "y") for k in (0, 100)]
    df = spark.createDataFrame(data, SCHEMA)
    changes = trailing.influence(df, ["shop"], "buyer", "partition_daily", 30, 0)
    assert sorted((r["at"], r["sign"]) for r in changes.collect()) == sorted(
        [(day(0), 1), (day(230), -1), (day(0), 1), (day(31), -1), (day(100), 1), (day(131), -1)]
    )
    with pytest.raises(ValueError):
        lookback_distinct_model(df, [day(0)], 0, [], {"n": "buyer"}, exclude_event_date=True)


def test_rows_grow_with_the_logarithm_of_the_window(spark):
    days, data = 365, [(day(k), "a", 1, None, 1.0, "x") for k in range(900)]
    dates = [day(k) for k in range(400, 900)]
    assert trailing.levels_for(days, 0) <= math.log2(days + 1) + 1  # copies of a day
    assert len(trailing.window_blocks(dates, days, 0)) <= 2 * math.log2(days + 1) * len(dates)
    df = spark.createDataFrame(data, SCHEMA)
    found = lookback_model(df, dates, days, ["shop", fct("weight", aggs=["sum", "max"])])
    found.collect()
    made, plan = [], found._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            node = node.plan()
        if node.nodeName().startswith(("Generate", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin")):
            made.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    in_windows = 900 - (400 - days)
    assert made and max(made) <= 2 * math.log2(days + 1) * in_windows < 366 * 500 / 10


@settings(max_examples=200, deadline=None)
@given(st.integers(-3000, 30000), st.integers(0, 900))
def test_blocks_make_up_the_window(first, length):
    blocks = trailing.decompose(first, first + length)
    assert [d for level, start in blocks for d in range(start, start + (1 << level))] == list(range(first, first + length + 1))
    assert all(start % (1 << level) == 0 for level, start in blocks)
    assert len(blocks) <= max(1, 2 * math.log2(length + 1))
    assert max(level for level, _ in blocks) < trailing.levels_for(length, 0)
