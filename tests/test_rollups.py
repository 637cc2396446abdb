"""Quantiles from logarithmic buckets, exact distinct counts that roll up, and deep pages."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamella import Pages, bitmap_counts, bucket_quantile, deep_page, distinct_bitmaps, merge_bitmaps, merge_buckets, quantile_buckets
from lamella.operators.rollups import bucket, bucket_count, middle


def test_every_value_is_near_the_middle_of_its_bucket(spark):
    r = random.Random(4)
    values = [r.uniform(-1, 1) * 10.0 ** r.randrange(-300, 300) for _ in range(2000)] + [5e-324, 1.7e308, -1.7e308, 1.0, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for accuracy in (0.01, 0.05):
        found = df.select("v", bucket(F.col("v"), accuracy).alias("b"), middle(bucket(F.col("v"), accuracy), accuracy).alias("m")).collect()
        assert all(abs(x.m - x.v) <= abs(x.v) * (accuracy + 1e-9) or abs(x.v) < 1e-307 for x in found)
        order = sorted(found, key=lambda x: x.v)
        assert [x.b for x in order] == sorted(x.b for x in order)
    with pytest.raises(ValueError):
        bucket(F.col("v"), 0.001)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(0.001, 1e6)), min_size=1, max_size=80))
def test_quantiles_after_merging(spark, values):
    df = spark.createDataFrame([(i % 2, i % 5, v) for i, v in enumerate(values)], "k int, hour int, v double")
    hourly = quantile_buckets(df, ["k", "hour"], {"b": "v", "twice": F.col("v") * 2})
    daily = merge_buckets(hourly, ["k"], ["b", "twice"])
    read = {f"q{q}": bucket_quantile(F.col("b"), q / 1000) for q in (0, 500, 980, 999, 1000)}
    rows = daily.select("k", bucket_count(F.col("b")).alias("n"), bucket_quantile(F.col("twice"), 0.5).alias("double"), *[c.alias(n) for n, c in read.items()])
    found = {x["k"]: x for x in rows.collect()}
    assert set(found) == {i % 2 for i in range(len(values))}
    for k, row in found.items():
        own = [v for i, v in enumerate(values) if i % 2 == k and v is not None]
        assert row["n"] == len(own)
        for name in read:
            exact = np.quantile(own, int(name[1:]) / 1000) if own else None
            assert (row[name] is None) == (exact is None)
            assert exact is None or abs(row[name] - exact) <= exact * 0.0101
        assert not own or abs(row["double"] - 2 * np.median(own)) <= 2 * np.median(own) * 0.0101


def test_tails_of_a_skewed_measure(spark):
    df = spark.range(200_000).selectExpr("id % 24 AS hour", "exp(abs(xxhash64(id) % 1000000) / 100000D) AS v")
    hourly = quantile_buckets(df, ["hour"], {"b": "v"})
    daily = merge_buckets(hourly, [], ["b"])
    exact = np.array([r[0] for r in df.select("v").collect()])
    row = daily.select(F.size("b").alias("size"), *[bucket_quantile(F.col("b"), q).alias(str(q)) for q in (0.98, 0.999, 0.9999)]).first()
    for q in (0.98, 0.999, 0.9999):
        assert abs(row[str(q)] / np.quantile(exact, q) - 1) <= 0.01
    assert row["size"] < 600  # the number of buckets grows with the range of the values, not with their number


def test_unusual_values_have_buckets(spark):
    values = [math.nan, math.inf, -math.inf, 0.0, -0.0, -5.0, 5.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    b = quantile_buckets(df, [], {"b": "v"})
    row = b.select(*[bucket_quantile(F.col("b"), q / 6).alias(f"q{q}") for q in range(7)]).first()
    assert row["q0"] == -math.inf and row["q5"] == math.inf and math.isnan(row["q6"])
    assert row["q1"] == pytest.approx(-5, rel=0.01) and row["q2"] == row["q3"] == 0 and row["q4"] == pytest.approx(5, rel=0.01)
    nothing = quantile_buckets(df.where("v IS NULL"), [], {"b": "v"}).select(bucket_quantile(F.col("b"), 0.5).alias("q"))
    assert [r["q"] for r in nothing.collect()] in ([], [None])


def test_distinct_counts_roll_up(spark, rows):
    df = spark.range(60_000).selectExpr("id % 3 AS k", "id % 24 AS hour", "nullif(xxhash64(id) % 90000, 7) AS user")
    hourly = distinct_bitmaps(df, ["k", "hour"], "user")
    assert hourly.count() <= 3 * 24 * 8
    exact = df.groupBy("k").agg(F.count_distinct("user").alias("users"))
    assert rows(bitmap_counts(hourly, ["k"], "users")) == rows(exact)
    twice = merge_bitmaps(merge_bitmaps(hourly, ["k"]), [])
    assert rows(bitmap_counts(twice, [], "users")) == rows(df.agg(F.count_distinct("user")))
    with pytest.raises(ValueError):
        distinct_bitmaps(df.withColumn("user", F.lit("a")), ["k"], "user")


@pytest.fixture(scope="module")
def shuffled(spark):
    r = random.Random(8)
    data = [(r.choice([None, 1, 2, 2, 2, 2, 5]), r.choice(["a", "b", None]), k // 2) for k in range(700)]
    return spark.createDataFrame(data, "x int, y string, z int").withColumn("m", F.create_map(F.lit("k"), F.col("x"))).repartition(5)


@pytest.mark.parametrize("order", ["x", [("x", "desc"), "y"], ["y", ("x", "asc")]])
@pytest.mark.parametrize("ranges", [1, 7, 60])
def test_pages_hold_every_row_once_in_order(shuffled, order, ranges):
    pages = Pages(shuffled, order, ranges)
    assert pages.rows == 700
    whole = [tuple(r)[:3] for at in range(0, 900, 90) for r in pages.page(at, 90).collect()]
    assert sorted(whole, key=repr) == sorted((tuple(r)[:3] for r in shuffled.collect()), key=repr)
    keys = [order] if isinstance(order, str) else order
    names = ["x", "y", "z"]
    for entry in reversed([(k, "asc") if isinstance(k, str) else k for k in keys]):
        i = names.index(entry[0])
        wanted = sorted(whole, key=lambda row: (row[i] is None, 0 if row[i] is None else row[i]), reverse=False)
        if entry[1] == "desc":
            present = sorted((r for r in whole if r[i] is not None), key=lambda row: row[i], reverse=True)
            wanted = present + [r for r in whole if r[i] is None]
        if entry[0] == (keys[0] if isinstance(keys[0], str) else keys[0][0]):
            assert [r[i] for r in whole] == [r[i] for r in wanted]


def test_a_page_reads_only_its_ranges(shuffled):
    pages = Pages(shuffled, ["z", "y"], 35)
    chosen, skipped = pages.holding(350, 5)
    assert 1 <= len(chosen) <= 2 and 0 <= skipped < 60
    page = pages.page(350, 5)
    assert page.count() == 5
    page.collect()
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "page range#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert max(b - a for a, b in zip([0, *pages.ends], pages.ends)) < 120  # no range holds very many rows


def test_pages_at_the_edges(spark, shuffled):
    pages = Pages(shuffled, "z", 9)
    assert pages.page(700, 10).count() == 0 and pages.page(695, 10).count() == 5
    assert pages.page(0, 0).count() == 0 and pages.page(0, 10_000).count() == 700
    assert Pages(shuffled.limit(0), "z").page(0, 5).count() == 0
    assert deep_page(shuffled, [("z", "desc")], 2, 2).select("z").collect() == [(348,), (348,)]
    same = spark.range(3000).select(F.lit(1).alias("k"))
    pages = Pages(same, "k", 10)
    assert max(b - a for a, b in zip([0, *pages.ends], pages.ends)) < 1500  # rows alike are spread over ranges
    for bad in ((-1, 5), (0, -5)):
        with pytest.raises(ValueError):
            pages.page(*bad)
    with pytest.raises(ValueError):
        Pages(same, "k", 0)


def test_bitmaps_of_few_ids_take_little_room(spark, rows):
    """Each group has one id of a bitmap; negative ones and ends of words and bitmaps too."""
    ids = [-32769, -32768, -1, 0, 1, 63, 64, 32767, 32768, 32769, 2**40, None]
    df = spark.createDataFrame([(k, i) for k, i in enumerate(ids * 2)], "k long, user long")
    single = distinct_bitmaps(df, ["k"], "user")
    assert single.select(F.max(F.octet_length(F.to_json("id_bitmap")))).first()[0] < 100
    assert rows(bitmap_counts(single, [], "users")) == [(len(ids) - 1,)]
    assert rows(bitmap_counts(single, ["k"], "users")) == rows(df.where("user IS NOT NULL").selectExpr("k", "1L AS users"))


def test_long_pages_pass_through_no_single_task(shuffled):
    pages = Pages(shuffled, [("x", "desc"), "y"], 30)
    page = pages.page(101, 480)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "Limit" not in plan and "TakeOrdered" not in plan and "SinglePartition" not in plan
    whole = [tuple(r)[:3] for at, n in ((0, 101), (101, 480), (581, 500)) for r in pages.page(at, n).collect()]
    assert sorted(whole, key=repr) == sorted((tuple(r)[:3] for r in shuffled.collect()), key=repr)
