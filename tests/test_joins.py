"""Interval joins and full joins with hot keys, against Spark's own joins, and what they read."""

import random
import re

import pytest
from oracle import REGISTRY
from pyspark.sql import functions as F

from lamella import Between, Join, dim, fct, join_models
from lamella.operators.joins import join_all

FOLDER = "/root/testdata/sf0.001"
INF, NAN = float("inf"), float("nan")


@pytest.fixture(scope="module")
def points(spark):
    r = random.Random(1)
    values = [r.choice([r.uniform(-50, 50), r.uniform(-1e6, 1e6), r.uniform(-1, 1) * 1e-9, float(r.randrange(9))]) for _ in range(120)]
    values += [None, INF, -INF, NAN, 0.0, -0.0, 1e308, -1e308, 5e-324, 3.0, 3.0]
    return spark.createDataFrame([(k, x, k % 3) for k, x in enumerate(values)], "id long, x double, grp int")


@pytest.fixture(scope="module")
def spans(spark):
    r = random.Random(2)
    ends = []
    for _ in range(90):
        low = r.choice([r.uniform(-60, 60), r.uniform(-1e6, 1e6), float(r.randrange(9))])
        ends.append((low, low + r.choice([0.0, r.uniform(0, 1), r.uniform(0, 1e5), 1e-12, -1.0])))
    ends += [(None, 1.0), (1.0, None), (-INF, INF), (-INF, 0.0), (0.0, INF), (5.0, NAN), (NAN, NAN), (-1e308, 1e308), (3.0, 3.0), (INF, INF)]
    return spark.createDataFrame([(k, lo, hi, k % 3) for k, (lo, hi) in enumerate(ends)], "span long, lo double, hi double, grp int")


def found(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("keys", [False, True])
@pytest.mark.parametrize("swapped", [False, True])
def test_interval_join(spark, points, spans, how, keys, swapped):
    base, other = (("s", spans), ("p", points)) if swapped else (("p", points), ("s", spans))
    on = ["grp"] if keys else []
    within = Between("p.x", "s.lo", "s.hi")
    out = join_all(*base, [Join(other[1], other[0], on, how, between=within)])
    got = found(out.select(F.col("p.id").alias("id"), F.col("s.span").alias("span")), "id", "span")
    same = within.condition() & (F.expr("p.grp = s.grp") if keys else F.lit(True))
    spark.conf.set("spark.sql.crossJoin.enabled", "true")
    want = base[1].alias(base[0]).join(other[1].alias(other[0]), same, how)
    assert got == found(want.select(F.col("p.id").alias("id"), F.col("s.span").alias("span")), "id", "span")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz", "decimal(30,4)", "long"])
def test_interval_types(spark, kind):
    number = kind in ("long", "decimal(30,4)")

    def made(expr):
        if number:
            return f"cast({expr} as {kind})"
        return f"cast(timestamp_seconds(({expr}) * 40000) as {kind})"

    a = spark.range(200).selectExpr("id", f"{made('id * 7 % 101')} AS at")
    b = spark.range(40).selectExpr("id AS span", f"{made('id * 13 % 90')} AS lo", f"{made('id * 13 % 90 + id % 5')} AS hi")
    got = join_models(("a", a), [Join(b, "b", between=Between("a.at", "b.lo", "b.hi"))], ["id", dim("span", side="b")])
    want = a.join(b, F.expr("at BETWEEN lo AND hi"))
    assert found(got, "id", "span") == found(want, "id", "span") and want.count() > 100


def test_interval_join_refuses(spark, points, spans):
    text = spans.withColumn("lo", F.lit("a")).withColumn("hi", F.lit("b"))
    with pytest.raises(ValueError):
        join_all("p", points, [Join(text, "s", between=Between("p.x", "s.lo", "s.hi"))])
    with pytest.raises(ValueError):
        join_all("p", points, [Join(spans, "s", between=Between("p.x", "s.lo", "p.x"))])
    with pytest.raises(ValueError):
        Join(spans, "s", how="cross", between=Between("p.x", "s.lo", "s.hi"))


def test_few_copies_of_points_and_intervals(spark):
    """An interval touches at most three bins; a point is looked up once a level."""
    points = spark.range(5000).selectExpr("id", "id * 1.5D AS x")
    spans = spark.range(300).selectExpr("id AS span", "id * 25D AS lo", "id * 25D + pow(2, id % 8) AS hi")
    out = join_all("p", points, [Join(spans, "s", between=Between("p.x", "s.lo", "s.hi"))])
    plan = out._jdf.queryExecution()
    out.count()
    rows = {}
    todo = [plan.executedPlan().executedPlan()] if "Adaptive" in plan.executedPlan().nodeName() else [plan.executedPlan()]
    out.collect()
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            node = node.plan()
        if node.nodeName() == "Generate":
            rows.setdefault(node.metrics().apply("numOutputRows").value(), True)
        todo += [node.children().apply(k) for k in range(node.children().size())]
    assert rows and all(n <= 3 * 300 or n <= 8 * 5000 for n in rows)


@pytest.fixture(scope="module")
def hot(spark):
    left = spark.range(4000).selectExpr(
        "id", "CASE WHEN id % 2 = 0 THEN 7 WHEN id % 50 = 1 THEN NULL ELSE cast(id AS int) END AS key", "cast(id % 4 AS int) AS part"
    )
    right = spark.range(500).selectExpr(
        "id AS other", "CASE WHEN id % 5 = 0 THEN 7L WHEN id % 50 = 1 THEN NULL ELSE id * 3 END AS key", "cast(id % 4 AS int) AS part"
    )
    return left, right


@pytest.mark.parametrize(
    "options, condition",
    [
        ({"on": ["key"]}, "a.key = b.key"),
        ({"on": ["key", "part"]}, "a.key = b.key AND a.part = b.part"),
        ({"on": ["key", "= a.id > b.other"]}, "a.key = b.key AND a.id > b.other"),
        ({"on": ["= a.key + 1 = b.key + 1"], "keys": [("a.key + 1", "b.key + 1")]}, "a.key = b.key"),
        ({"on": ["= a.key = b.key"]}, "a.key = b.key"),
    ],
)
def test_full_join_with_hot_keys(hot, options, condition):
    left, right = hot
    on = [F.expr(k[2:]) if k.startswith("= ") else k for k in options["on"]]
    out = join_all("a", left, [Join(right, "b", how="full", skewed=True, **(options | {"on": on}))])
    got = out.select("a.id", "b.other").groupBy("id", "other").count()
    want = left.alias("a").join(right.alias("b"), F.expr(condition), "full").select("a.id", "b.other").groupBy("id", "other").count()
    assert found(got, "id", "other", "count") == found(want, "id", "other", "count")


@pytest.mark.parametrize("empty", ["left", "right", "both"])
def test_full_join_with_an_empty_side(hot, empty):
    left, right = (df.limit(0) if empty in (side, "both") else df for side, df in zip(("left", "right"), hot))
    out = join_all("a", left, [Join(right, "b", ["key"], "full", skewed=True)])
    assert out.count() == left.count() + right.count()


def test_full_join_keys_of_other_types(spark):
    left = spark.sql("SELECT * FROM VALUES (1D, 'a'), (0D, 'b'), (2D, 'c'), (CAST('NaN' AS DOUBLE), 'd') AS t(key, l)")
    right = spark.sql("SELECT * FROM VALUES (1, 'x'), (0, 'y'), (3, 'z') AS t(key, r)")
    negative = spark.sql("SELECT * FROM VALUES (-0D, 'n'), (CAST('NaN' AS DOUBLE), 'm') AS t(key, r)")
    for other in (right, negative):
        out = join_all("a", left, [Join(other, "b", ["key"], "full", skewed=True)])
        want = left.alias("a").join(other.alias("b"), F.expr("a.key = b.key"), "full")
        assert found(out.select("a.l", "b.r"), "l", "r") == found(want.select("a.l", "b.r"), "l", "r")


def reads(spark, run):
    """How often the given tables are read while ``run`` works, by the plans of all its jobs."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = store.executionsList(before, 1000)
    plans = [found.apply(k).physicalPlanDescription() for k in range(found.size())]
    n = 0
    for p in plans:
        scans = set(re.findall(r"Scan parquet\s*\((\d+)\)", p.split("== Initial Plan ==")[0]))
        places = dict(re.findall(r"\n\((\d+)\) Scan parquet.*?\nLocation: ([^\n]*)", p, re.DOTALL))
        n += sum("testdata" in places[k] for k in scans)
    return n


def test_full_join_reads_each_source_once(spark):
    REGISTRY["join_full_skewed"].run(spark, FOLDER)
    assert reads(spark, lambda: REGISTRY["join_full_skewed"].run(spark, FOLDER).collect()) == 2
    assert reads(spark, lambda: REGISTRY["join_inner"].run(spark, FOLDER).collect()) == 2


def test_full_join_splits_only_what_spark_can(spark):
    plan = REGISTRY["join_full_skewed"].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "LeftOuter" in plan and "FullOuter" in plan


def _counts(points, spans, how, swapped, measures):
    base, other = (("s", spans), ("p", points)) if swapped else (("p", points), ("s", spans))
    within = Between("p.x", "s.lo", "s.hi")
    return join_models(base, [Join(other[1], other[0], how=how, between=within)], measures), base, other, within


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("swapped", [False, True])
def test_counts_of_an_interval_join(spark, points, spans, how, swapped):
    """Counts without pairs agree with those of Spark's own join: null groups, empty sides, equal and infinite ends."""
    points = points.selectExpr("id", "x", "nullif(grp, 1) AS kind", "if(id % 4 = 0, null, id) AS seen")
    points = points.unionByName(points.where("id % 3 = 0"))
    spans = spans.selectExpr("lo", "hi", "nullif(grp, 2) AS band", "if(span % 5 = 0, null, span) AS named")
    for p, s in ((points, spans), (points.limit(0), spans), (points, spans.limit(0))):
        measures = [
            dim("kind", side="p"), dim("band", side="s"), fct("n", "count(*)"), fct("seen", "count(p.seen)"),
            fct("named", "count(s.named)"), fct("x", agg="max", side="p"),
        ]
        out, base, other, within = _counts(p, s, how, swapped, measures)
        joined = base[1].alias(base[0]).join(other[1].alias(other[0]), within.condition(), how)
        want = joined.groupBy("p.kind", "s.band").agg(
            F.count("*").alias("n"), F.count("p.seen").alias("seen"), F.count("s.named").alias("named"), F.max("p.x").alias("x_max")
        )
        columns = ["kind", "band", "n", "seen", "named", "x_max"]
        assert repr(found(out, *columns)) == repr(found(want, *columns))  # nan is among the largest points


def test_different_values_in_an_interval_join(spark, points, spans):
    points = points.selectExpr("x", "nullif(grp, 1) AS kind", "if(id % 4 = 0, null, id % 30) AS seen")
    spans = spans.selectExpr("lo", "hi", "nullif(grp, 2) AS band")
    measures = [dim("kind", side="p"), dim("band", side="s"), fct("n", "count(*)"), fct("seen", "count(distinct p.seen)")]
    for swapped in (False, True):
        out, base, other, within = _counts(points, spans, "inner", swapped, measures)
        joined = base[1].alias(base[0]).join(other[1].alias(other[0]), within.condition())
        want = joined.groupBy("p.kind", "s.band").agg(F.count("*").alias("n"), F.countDistinct("p.seen").alias("seen"))
        assert found(out, "kind", "band", "n", "seen") == found(want, "kind", "band", "n", "seen")


def test_counted_interval_joins_make_no_pairs(spark):
    """No operator puts out more rows than both sides have, times the few groups of one."""
    points = spark.range(4000).selectExpr("id", "id % 2 AS kind", "id * 1.0D AS x")
    spans = spark.range(2000).selectExpr("id % 3 AS band", "id * 0.5D AS lo", "id * 0.5D + 2000 AS hi")
    out = _counts(points, spans, "left", False, [dim("kind", side="p"), dim("band", side="s"), fct("n", "count(*)")])[0]
    assert sum(r["n"] for r in out.collect()) > 4_000_000 and "interval bin" not in out._jdf.queryExecution().toString()
