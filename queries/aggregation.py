"""Aggregation, rollups, trailing windows, sketches."""

from pyspark.sql import functions as F

from lamella import (
    Metric,
    bitmap_counts,
    bucket_metrics,
    bucket_quantile,
    dim,
    distinct_bitmaps,
    fct,
    grain,
    lookback_distinct_model,
    lookback_model,
    merge_bitmaps,
    merge_buckets,
    metric_query,
    quantile_buckets,
    rollup_model,
    select_model,
    standard_metric,
)
from queries.base import WEEK, day, moment, query, staged_events, staged_orders


@query(
    "aggs_multi",
    """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity_sum,
        CAST(count(l_quantity) AS BIGINT) AS l_quantity_count, round(min(l_quantity), 2) AS l_quantity_min,
        round(max(l_quantity), 2) AS l_quantity_max, round(sum(l_extendedprice), 2) AS l_extendedprice_sum
    FROM lineitem GROUP BY l_returnflag, l_linestatus
    """,
)
def aggs_multi(t):
    quantity = fct("l_quantity", aggs=["sum", "count", "min", "max"])
    return select_model(
        t.lineitem, ["l_returnflag", "l_linestatus", quantity, fct("l_extendedprice", agg="sum")]
    )


def _per_supplier(t):
    return select_model(t.lineitem, ["l_suppkey", "l_returnflag", fct("l_orderkey", agg="count")])


@query(
    "count_reagg",
    """SELECT l_returnflag, CAST(count(l_orderkey) AS BIGINT) AS l_orderkey_count
        FROM lineitem GROUP BY l_returnflag""",
)
def count_reagg(t):
    # A stored count is summed and keeps its name.
    return select_model(_per_supplier(t), ["l_returnflag", fct("l_orderkey_count", agg="count")])


@query(
    "suffix_override",
    """
    SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS l_orderkey_count_count,
        CAST(max(n) AS BIGINT) AS l_orderkey_count_max
    FROM (SELECT l_suppkey, l_returnflag, count(l_orderkey) AS n FROM lineitem GROUP BY 1, 2)
    GROUP BY l_returnflag
    """,
)
def suffix_override(t):
    again = fct("l_orderkey_count", agg="count", override_suffix=True)
    return select_model(_per_supplier(t), ["l_returnflag", again, fct("l_orderkey_count", agg="max")])


@query(
    "group_dims",
    """
    SELECT year(l_shipdate) AS ship_year, l_returnflag, CAST(count(*) AS BIGINT) AS n
    FROM lineitem GROUP BY 1, 2
    """,
)
def group_dims(t):
    year = dim("ship_year", "cast(year(l_shipdate) as bigint)")
    return select_model(t.lineitem, [year, "l_returnflag", fct("n", "count(*)")], group_by="dims")


@query(
    "group_expr",
    """
    SELECT l_returnflag, round(sum(l_quantity), 2) AS l_quantity_sum FROM lineitem
    GROUP BY l_returnflag, year(l_shipdate)
    """,
)
def group_expr(t):
    return select_model(
        t.lineitem, ["l_returnflag", fct("l_quantity", agg="sum")], group_by=["year(l_shipdate)"]
    )


@query(
    "exclude_group",
    f"""
    SELECT l_returnflag, {day("max(l_shipdate)")} AS last_shipped, round(sum(l_quantity), 2) AS l_quantity_sum
    FROM lineitem GROUP BY l_returnflag
    """,
)
def exclude_group(t):
    last = dim("last_shipped", "to_date(max(l_shipdate))", exclude_from_group_by=True)
    return select_model(t.lineitem, ["l_returnflag", last, fct("l_quantity", agg="sum")])


@query(
    "expr_aggs",
    """
    SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers,
        round(avg(l_quantity), 2) AS mean_quantity,
        round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END), 2) AS open_quantity,
        round(min(l_extendedprice), 2) AS lowest, round(max(l_extendedprice), 2) AS highest
    FROM lineitem GROUP BY l_returnflag
    """,
)
def expr_aggs(t):
    return select_model(
        t.lineitem,
        [
            "l_returnflag",
            fct("n", "count(*)"),
            fct("suppliers", "count(distinct l_suppkey)"),
            fct("mean_quantity", "avg(l_quantity)"),
            fct("open_quantity", "sum(case when l_linestatus = 'O' then l_quantity else 0 end)"),
            fct("lowest", "min(l_extendedprice)"),
            fct("highest", "max(l_extendedprice)"),
        ],
        group_by="dims",
    )


@query("distinct_group", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_group(t):
    return select_model(t.lineitem, ["l_returnflag", "l_linestatus"], group_by="dims")


def _hourly(t):
    """Stored hourly measures, the input of the rollups."""
    measures = fct("value", aggs=["sum", "count", "min", "max"])
    return select_model(staged_events(t), ["event_type", grain("hour"), measures])


def _rollup_sql(interval, partitions, where=""):
    return f"""
    SELECT event_type, {moment(f"date_trunc('{interval}', ts)")} AS datetime{partitions},
        round(sum(value), 2) AS value_sum, CAST(count(value) AS BIGINT) AS value_count,
        round(min(value), 2) AS value_min, round(max(value), 2) AS value_max,
        CAST(count(*) AS BIGINT) AS source_row_count
    FROM events {where} GROUP BY ALL
    """


_MONTHLY = f", {day("date_trunc('month', ts)")} AS partition_monthly"
_DAILY = f", {day('ts')} AS partition_daily"


@query(
    "rollup_day",
    _rollup_sql("day", _MONTHLY + _DAILY, "WHERE CAST(ts AS DATE) BETWEEN '2024-01-05' AND '2024-01-11'"),
)
def rollup_day(t):
    return rollup_model(_hourly(t), "day", dates=WEEK)


@query("rollup_month", _rollup_sql("month", _MONTHLY))
def rollup_month(t):
    # A month is recomputed whole: the daily filter does not apply at this grain.
    return rollup_model(_hourly(t), "month", dates=WEEK)


@query("rollup_year", _rollup_sql("year", ""))
def rollup_year(t):
    return rollup_model(_hourly(t), "year")


@query(
    "rollup_twice",
    _rollup_sql("month", _MONTHLY),
)
def rollup_twice(t):
    return rollup_model(rollup_model(_hourly(t), "day"), "month")


@query(
    "rollup_select",
    f"""
    SELECT o_orderstatus, {moment("date_trunc('month', o_orderdate)")} AS datetime,
        {day("date_trunc('month', o_orderdate)")} AS partition_monthly,
        round(sum(o_totalprice), 2) AS o_totalprice_sum, CAST(count(*) AS BIGINT) AS source_row_count,
        CAST(count(DISTINCT CAST(o_orderdate AS DATE)) AS BIGINT) AS active_days
    FROM orders GROUP BY ALL
    """,
)
def rollup_select(t):
    daily = select_model(
        staged_orders(t), ["o_orderstatus", grain("day"), fct("o_totalprice", agg="sum")]
    )
    return select_model(
        daily,
        ["o_orderstatus", fct("o_totalprice_sum"), fct("active_days", "count(distinct partition_daily)")],
        rollup="month",
    )


@query(
    "rollup_other_time",
    f"""
    SELECT l_returnflag, {moment("date_trunc('year', l_shipdate + INTERVAL 30 DAY)")} AS datetime,
        round(sum(l_quantity), 2) AS l_quantity_sum
    FROM lineitem GROUP BY ALL
    """,
)
def rollup_other_time(t):
    shipped = select_model(
        t.lineitem, ["l_returnflag", dim("shipped", "l_shipdate"), fct("l_quantity", agg="sum")]
    )
    return select_model(
        shipped,
        ["l_returnflag", fct("l_quantity_sum")],
        rollup="year",
        datetime_expr="shipped + interval 30 days",
    )


@query(
    "rollup_merge_rule",
    """
    SELECT l_returnflag, CAST(max(n) AS BIGINT) AS l_orderkey_count,
        strftime(d, '%Y-%m-%d %H:%M:%S.%f') AS datetime
    FROM (SELECT l_returnflag, date_trunc('year', l_shipdate) AS d, l_shipdate, count(l_orderkey) AS n
          FROM lineitem GROUP BY ALL) GROUP BY l_returnflag, d
    """,
)
def rollup_merge_rule(t):
    daily = select_model(
        t.lineitem, ["l_returnflag", dim("datetime", "l_shipdate"), fct("l_orderkey", agg="count")]
    )
    return rollup_model(daily, "year", merge_rules={"l_orderkey_count": "max"})


def _lookback_sql(days, first, facts, dates="'2024-01-05'", last="'2024-01-11'"):
    return f"""
    WITH dates AS (SELECT CAST(unnest(generate_series(DATE {dates}, DATE {last}, INTERVAL 1 DAY)) AS DATE) AS e),
    stored AS (SELECT *, CAST(ts AS DATE) AS d FROM events)
    SELECT event_type, {day("e")} AS partition_daily, {facts}
    FROM dates INNER JOIN stored ON d <= e - {first} AND d >= e - {days} GROUP BY event_type, e
    """


_SUMS = """round(sum(value), 2) AS value_sum, CAST(count(value) AS BIGINT) AS value_count,
    round(min(value), 2) AS value_min, round(max(value), 2) AS value_max"""


@query("lookback_7d", _lookback_sql(7, 0, _SUMS))
def lookback_7d(t):
    measures = fct("value", aggs=["sum", "count", "min", "max"])
    return lookback_model(staged_events(t), WEEK, 7, ["event_type", measures])


@query("lookback_7d_exclusive", _lookback_sql(7, 1, _SUMS))
def lookback_7d_exclusive(t):
    measures = fct("value", aggs=["sum", "count", "min", "max"])
    return lookback_model(staged_events(t), WEEK, 7, ["event_type", measures], exclude_event_date=True)


@query(
    "lookback_distinct",
    _lookback_sql(3, 0, "CAST(count(DISTINCT user_id) AS BIGINT) AS users", last="'2024-01-30'"),
)
def lookback_distinct(t):
    users = fct("users", "count(distinct user_id)")
    picked = ["event_type", users]
    return lookback_model(staged_events(t), "2024-01-05~2024-01-30", 3, picked, distinct_on=["user_id"])


@query(
    "lookback_distinct_rows",
    _lookback_sql(3, 0, "CAST(count(DISTINCT user_id) AS BIGINT) AS users", last="'2024-01-30'"),
)
def lookback_distinct_rows(t):
    users = fct("users", "count(distinct user_id)")
    return lookback_model(staged_events(t), "2024-01-05~2024-01-30", 3, ["event_type", users])


_YEAR = "1995-01-01~1995-12-31"


def _orders_sql(days, first, facts, group="o_orderpriority"):
    return f"""
    WITH dates AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1995-12-31', INTERVAL 1 DAY)) AS DATE) AS e),
    stored AS (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT {group}, {day("e")} AS partition_daily, {facts}
    FROM dates INNER JOIN stored ON d <= e - {first} AND d >= e - {days} GROUP BY {group}, e
    """


_PRICES = """round(sum(o_totalprice), 2) AS o_totalprice_sum, CAST(count(o_totalprice) AS BIGINT) AS o_totalprice_count,
    round(min(o_totalprice), 2) AS o_totalprice_min, round(max(o_totalprice), 2) AS o_totalprice_max"""


@query(
    "lookback_365d",
    _orders_sql(365, 0, _PRICES + ", CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, true AS within_bound"),
)
def lookback_365d(t):
    """A year's windows on each day of a year: blocks of days, not a copy of each day for each date.

    The sketch's distinct count is held against the exact one.
    """
    orders = staged_orders(t)
    measures = [fct("o_totalprice", aggs=["sum", "count", "min", "max"]), fct("o_custkey", agg="hll")]
    found = lookback_model(orders, _YEAR, 365, ["o_orderpriority", *measures])
    exact = lookback_distinct_model(orders, _YEAR, 365, ["o_orderpriority"], {"customers": "o_custkey"})
    joined = found.join(exact, ["o_orderpriority", "partition_daily"])
    off = F.abs(F.hll_sketch_estimate("o_custkey_hll") - F.col("customers"))
    return joined.withColumn("within_bound", off <= F.col("customers") * 0.05).drop("o_custkey_hll")


@query(
    "lookback_365d_counts",
    _orders_sql(
        365,
        1,
        """CAST(count(o_totalprice) AS BIGINT) AS o_totalprice_count, CAST(sum(o_orderkey) AS BIGINT) AS o_orderkey_sum,
        round(sum(CAST(o_totalprice AS DECIMAL(12, 2))), 2)::DOUBLE AS price_sum""",
        "o_orderpriority, o_orderstatus",
    ),
)
def lookback_365d_counts(t):
    """Counts and exact sums over a year's windows: each day enters them once and leaves them once."""
    measures = [
        fct("o_totalprice", agg="count"),
        fct("o_orderkey", agg="sum"),
        fct("price", "cast(o_totalprice as decimal(12, 2))", agg="sum"),
    ]
    picked = ["o_orderpriority", "o_orderstatus", *measures]
    return lookback_model(staged_orders(t), _YEAR, 365, picked, exclude_event_date=True)


@query(
    "lookback_distinct_90d",
    _orders_sql(90, 0, """CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers,
        CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS priorities""", "o_orderstatus"),
)
def lookback_distinct_90d(t):
    """Exact distinct counts over 90 days for every day of a year: two rows for each interval in which a value is seen."""
    counted = {"customers": "o_custkey", "priorities": "o_orderpriority"}
    return lookback_distinct_model(staged_orders(t), _YEAR, 90, ["o_orderstatus"], counted)


@query("lookback_distinct_90d_exclusive", _orders_sql(90, 1, "CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers"))
def lookback_distinct_90d_exclusive(t):
    return lookback_distinct_model(
        staged_orders(t), _YEAR, 90, ["o_orderpriority"], {"customers": "o_custkey"}, exclude_event_date=True
    )


def _hll_bound(estimate, exact, keys):
    """Exact distinct counts, and whether the sketch's are within 5 % of them."""
    joined = exact.join(estimate, keys)
    within = F.abs(F.col("estimate") - F.col("exact")) <= F.col("exact") * 0.05
    return joined.select(*keys, "exact", within.alias("within_bound"))


@query(
    "hll_distinct",
    """SELECT event_type, count(DISTINCT user_id) AS exact, true AS within_bound FROM events GROUP BY 1""",
)
def hll_distinct(t):
    built = select_model(t.events, ["event_type", fct("user_id", agg="hll")])
    estimate = standard_metric("user_id_hll", "distinctcount", name="estimate")
    exact = t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    return _hll_bound(metric_query(built, ["event_type"], [estimate]), exact, ["event_type"])


@query(
    "hll_rollup",
    f"""SELECT event_type, {day("ts")} AS partition_daily, count(DISTINCT user_id) AS exact, true AS within_bound
        FROM events GROUP BY 1, 2""",
)
def hll_rollup(t):
    """Hourly sketches are united to days, whose counts are those of the days' rows."""
    staged = staged_events(t)
    hourly = select_model(staged, ["event_type", grain("hour"), fct("user_id", agg="hll")])
    keys = ["event_type", "partition_daily"]
    estimate = standard_metric("user_id_hll", "distinctcount", name="estimate")
    exact = staged.groupBy(*keys).agg(F.count_distinct("user_id").alias("exact"))
    return _hll_bound(metric_query(rollup_model(hourly, "day"), keys, [estimate]), exact, keys)


def _kll_query(metric, percent):
    @query(
        f"kll_{metric}",
        f"""SELECT event_type, round(quantile_cont(value, {percent / 100}), 2) AS exact, true AS within_bound
            FROM events GROUP BY 1""",
    )
    def run(t):
        """Hourly sketches are merged; the result lies between exact percentiles one and a half points around."""
        hourly = select_model(staged_events(t), ["event_type", grain("hour"), fct("value", agg="tdigest")])
        read = metric_query(hourly, ["event_type"], [standard_metric("value_tdigest", metric, name="estimate")])
        points = {"low": percent - 1.5, "exact": percent, "high": percent + 1.5}
        wanted = [Metric(n, "percentile", "value", p) for n, p in points.items()]
        exact = metric_query(t.events, ["event_type"], wanted)
        within = F.col("estimate").between(F.col("low"), F.col("high"))
        return exact.join(read, "event_type").select("event_type", "exact", within.alias("within_bound"))

    return run


for _metric, _percent in (("p50", 50), ("p90", 90), ("p95", 95), ("p98", 98)):
    _kll_query(_metric, _percent)


@query(
    "window_nested_call",
    f"""SELECT event_id, {day("ts")} AS partition_daily,
        round(sum(coalesce(value, 0)) OVER (PARTITION BY event_type, CAST(ts AS DATE)), 2) AS day_total FROM events""",
)
def window_nested_call(t):
    total = fct("day_total", "sum(coalesce(value, 0)) over (partition by event_type, partition_daily)")
    return select_model(staged_events(t), ["event_id", "partition_daily", total], inherit_time=False, row_count=False)


@query("avg_without_group_by", "SELECT event_type, round(avg(value), 2) AS mean FROM events GROUP BY 1")
def avg_without_group_by(t):
    return select_model(t.events, ["event_type", fct("mean", "avg(value)")])


@query(
    "hll_error_bound",
    "SELECT event_type, true AS within_bound FROM events GROUP BY event_type",
)
def hll_error_bound(t):
    """The sketch's distinct count is within 5 % of the exact one."""
    built = select_model(t.events, ["event_type", fct("event_id", agg="hll"), fct("exact", "count(distinct event_id)")])
    read = metric_query(
        built,
        ["event_type"],
        [standard_metric("event_id_hll", "distinctcount", name="estimate"), Metric("exact", "sum", "exact")],
    )
    return read.select(
        "event_type", (F.abs(F.col("estimate") - F.col("exact")) <= F.col("exact") * 0.05).alias("within_bound")
    )


@query(
    "kll_error_bound",
    "SELECT event_type, true AS within_bound FROM events GROUP BY event_type",
)
def kll_error_bound(t):
    """The sketch's median lies between the exact 47th and 53rd percentile."""
    built = select_model(t.events, ["event_type", fct("value", agg="tdigest")])
    read = metric_query(built, ["event_type"], [standard_metric("value_tdigest", "p50", name="estimate")])
    exact = metric_query(
        t.events,
        {"kind": "event_type"},
        [Metric("low", "percentile", "value", 47), Metric("high", "percentile", "value", 53)],
    )
    joined = read.join(exact, F.col("event_type") == F.col("kind"))
    return joined.select("event_type", F.col("estimate").between(F.col("low"), F.col("high")).alias("within_bound"))


def _tail_query(name, q):
    @query(
        f"buckets_{name}",
        f"""SELECT event_type, {day("ts")} AS partition_daily, round(quantile_cont(value, {q}), 6) AS exact, true AS within_bound
            FROM events WHERE value IS NOT NULL GROUP BY ALL""",
        digits=6,
    )
    def run(t):
        """Hourly buckets merged to days: within 1 % of the exact quantile, in the tail too."""
        staged, keys = staged_events(t), ["event_type", "partition_daily"]
        hourly = quantile_buckets(staged, [*keys, "partition_hourly"], {"value_buckets": "value"})
        daily = merge_buckets(hourly, keys, ["value_buckets"])
        estimate = daily.select(*keys, bucket_quantile(F.col("value_buckets"), q).alias("estimate"))
        exact = metric_query(staged, keys, [Metric("exact", "percentile", "value", q * 100)])
        within = F.abs(F.col("estimate") - F.col("exact")) <= F.abs(F.col("exact")) * 0.01 + 1e-9
        return exact.join(estimate, keys).select(*keys, "exact", within.alias("within_bound"))

    return run


for _name, _q in (("p50", 0.5), ("p98", 0.98), ("p999", 0.999)):
    _tail_query(_name, _q)


@query(
    "buckets_to_months",
    """SELECT o_orderpriority, strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS year,
        round(quantile_cont(o_totalprice, 0.999), 6) AS exact, true AS within_bound FROM orders GROUP BY ALL""",
    digits=6,
)
def buckets_to_months(t):
    """Daily buckets rolled up to months, and those read by year, against exact quantiles."""
    orders = staged_orders(t).withColumn("year", F.trunc("partition_daily", "year"))
    daily = quantile_buckets(orders, ["o_orderpriority", "partition_daily", "partition_monthly", "year"], {"price": "o_totalprice"})
    monthly = merge_buckets(daily, ["o_orderpriority", "partition_monthly", "year"], ["price"])
    keys = ["o_orderpriority", "year"]
    read = bucket_metrics(monthly, keys, {"estimate": ("price", 0.999)})
    exact = metric_query(orders, keys, [Metric("exact", "percentile", "o_totalprice", 99.9)])
    within = F.abs(F.col("estimate") - F.col("exact")) <= F.col("exact") * 0.01
    return exact.join(read, keys).select(*keys, "exact", within.alias("within_bound"))


@query(
    "distinct_bitmaps_day",
    f"""SELECT event_type, {day("ts")} AS partition_daily, CAST(count(DISTINCT user_id) AS BIGINT) AS users
        FROM events GROUP BY 1, 2""",
)
def distinct_bitmaps_day(t):
    """Users of each hour as bitmaps, united to days: exact, unlike a sum of hourly counts or a sketch."""
    keys = ["event_type", "partition_daily"]
    hourly = distinct_bitmaps(staged_events(t), [*keys, "partition_hourly"], "user_id")
    return bitmap_counts(hourly, keys, "users")


@query(
    "distinct_bitmaps_month",
    f"""SELECT o_orderpriority, {day("date_trunc('month', o_orderdate)")} AS partition_monthly,
        CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers FROM orders GROUP BY 1, 2""",
)
def distinct_bitmaps_month(t):
    """Customers of each day, united to months."""
    daily = distinct_bitmaps(staged_orders(t), ["o_orderpriority", "partition_monthly", "partition_daily"], "o_custkey")
    monthly = merge_bitmaps(daily, ["o_orderpriority", "partition_monthly"])
    return bitmap_counts(monthly, ["o_orderpriority", "partition_monthly"], "customers")
