"""Metric queries over marts."""

import datetime as dt

from pyspark.sql import functions as F

from lamella import Metric, fct, grain, in_the_past, metric_query, select_model, standard_metric, time_interval
from lamella.plans import metrics as M
from queries.base import day, moment, query, staged_events


def _mart(t):
    """Daily measures of the events."""
    measures = fct("value", aggs=["sum", "count", "min", "max"])
    return select_model(staged_events(t), ["event_type", grain("day"), measures])


def _standard_query(metric, sql):
    @query(f"metric_{metric}", f"SELECT event_type, {sql} AS result FROM events GROUP BY event_type")
    def run(t):
        column = "value" if metric == "avg" else f"value_{metric}"
        return metric_query(_mart(t), ["event_type"], [standard_metric(column, metric, name="result")])

    return run


for _metric, _sql in (
    ("avg", "round(sum(value) / count(value), 2)"),
    ("count", "CAST(count(value) AS BIGINT)"),
    ("sum", "round(sum(value), 2)"),
    ("min", "round(min(value), 2)"),
    ("max", "round(max(value), 2)"),
):
    _standard_query(_metric, _sql)


@query(
    "metric_avg_empty",
    """SELECT event_type, 0.0 AS result FROM events GROUP BY event_type""",
)
def metric_avg_empty(t):
    # Without any counted value the average is 0, not an error.
    none = _mart(t).withColumn("value_count", F.lit(0).cast("bigint"))
    return metric_query(none, ["event_type"], [standard_metric("value", "avg", name="result")])


def _custom_query(kind, expected, metric):
    @query(f"metric_custom_{kind}", f"SELECT event_type, {expected} AS result FROM events GROUP BY event_type")
    def run(t):
        return metric_query(t.events, ["event_type"], [Metric("result", kind, **metric)])

    return run


for _kind, _sql, _options in (
    ("average", "round(avg(value), 2)", {"sql": "value"}),
    ("count", "CAST(count(value) AS BIGINT)", {"sql": "value"}),
    ("count_distinct", "CAST(count(DISTINCT user_id) AS BIGINT)", {"sql": "user_id"}),
    ("max", "round(max(value), 2)", {"sql": "value"}),
    ("min", "round(min(value), 2)", {"sql": "value"}),
    ("sum", "round(sum(value), 2)", {"sql": "value"}),
    ("median", "round(quantile_cont(user_id, 0.5), 2)", {"sql": "user_id"}),
    ("percentile", "round(quantile_cont(user_id, 0.9), 2)", {"sql": "user_id", "percentile": 90}),
    ("number", "round(sum(value) / count(*), 2)", {"sql": "sum(value) / count(*)"}),
    ("boolean", "max(value) > 350", {"sql": "max(value) > 350"}),
    ("date", f"{day('max(ts)')}", {"sql": "to_date(max(ts))"}),
    ("string", "upper(max(event_type))", {"sql": "upper(max(event_type))"}),
):
    _custom_query(_kind, _sql, _options)


@query(
    "metric_filtered",
    """
    SELECT event_type, CAST(count(*) FILTER (WHERE value > 100) AS BIGINT) AS large,
        CAST(count(DISTINCT user_id) FILTER (WHERE value > 100) AS BIGINT) AS large_users,
        round(quantile_cont(user_id, 0.5) FILTER (WHERE value > 100), 2) AS middle_user,
        round(sum(value), 2) AS total
    FROM events GROUP BY event_type HAVING sum(value) > 1000 ORDER BY event_type LIMIT 4
    """,
)
def metric_filtered(t):
    return metric_query(
        t.events,
        ["event_type"],
        [
            Metric("large", "count", filters="value > 100"),
            Metric("large_users", "count_distinct", "user_id", filters="value > 100"),
            Metric("middle_user", "median", "user_id", filters="value > 100"),
            Metric("total", "sum", "value"),
        ],
        having="total > 1000",
        order_by="event_type",
        limit=4,
    )


_INTERVAL_SQL = {
    "RAW": moment("o_orderdate"),
    "HOUR": moment("date_trunc('hour', o_orderdate)"),
    "DAY": day("o_orderdate"),
    "WEEK": day("date_trunc('week', o_orderdate)"),
    "MONTH": day("date_trunc('month', o_orderdate)"),
    "QUARTER": day("date_trunc('quarter', o_orderdate)"),
    "YEAR": day("date_trunc('year', o_orderdate)"),
    "DAY_OF_WEEK_INDEX": "CAST(isodow(o_orderdate) - 1 AS INTEGER)",
    "DAY_OF_WEEK_NAME": "dayname(o_orderdate)",
    "DAY_OF_MONTH_NUM": "CAST(day(o_orderdate) AS INTEGER)",
    "DAY_OF_YEAR_NUM": "CAST(dayofyear(o_orderdate) AS INTEGER)",
    "WEEK_NUM": "CAST(weekofyear(o_orderdate) AS INTEGER)",
    "MONTH_NUM": "CAST(month(o_orderdate) AS INTEGER)",
    "MONTH_NAME": "monthname(o_orderdate)",
    "QUARTER_NUM": "CAST(quarter(o_orderdate) AS INTEGER)",
    "QUARTER_NAME": "'Q' || quarter(o_orderdate)",
    "YEAR_NUM": "CAST(year(o_orderdate) AS INTEGER)",
}


def _interval_query(interval):
    @query(
        f"time_interval_{interval.lower()}",
        f"""SELECT {_INTERVAL_SQL[interval]} AS part, CAST(count(*) AS BIGINT) AS orders,
            round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""",
    )
    def run(t):
        return metric_query(
            t.orders,
            {"part": time_interval("o_orderdate", interval)},
            [Metric("orders", "count"), Metric("total", "sum", "o_totalprice")],
        )

    return run


for _interval in M.INTERVALS:
    _interval_query(_interval)


_ASOF = dt.date(2024, 1, 25)


@query(
    "in_the_past_days",
    """SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events
        WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-11' AND DATE '2024-01-25' GROUP BY 1""",
)
def in_the_past_days(t):
    amount, unit = M.default_window(_mart(t))
    window = in_the_past("partition_daily", amount, unit, _ASOF)
    return metric_query(_mart(t), ["event_type"], [Metric("n", "sum", "source_row_count")], filters=[window])


@query(
    "in_the_past_months",
    """SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders
        WHERE o_orderdate BETWEEN DATE '1998-10-31' AND DATE '1998-12-31' GROUP BY 1""",
)
def in_the_past_months(t):
    window = in_the_past(F.to_date("o_orderdate"), 2, "months", dt.date(1998, 12, 31))
    return metric_query(t.orders, ["o_orderstatus"], [Metric("n", "count")], filters=[window])


@query(
    "sql_filter",
    f"""SELECT {day("ts")} AS finest, CAST(count(*) AS BIGINT) AS n FROM events
        WHERE value < 200 AND lower(event_type) = 'click' GROUP BY 1""",
)
def sql_filter(t):
    mart = select_model(staged_events(t).drop("partition_hourly"))
    return metric_query(
        mart,
        {"finest": F.col(M.metric_time_column(mart))},
        [Metric("n", "sum", "source_row_count")],
        filters=[M.equals_text("event_type", "CLICK", case_sensitive=False)],
        table_filter="value < 200",
    )


@query(
    "metric_no_dims",
    """SELECT CAST(count(*) AS BIGINT) AS orders, round(quantile_cont(o_totalprice, 0.25), 2) AS low,
        round(quantile_cont(o_totalprice, 0.75), 2) AS high FROM orders""",
)
def metric_no_dims(t):
    price = F.col("o_totalprice")
    return metric_query(
        t.orders,
        [],
        [
            Metric("orders", "count"),
            Metric("low", "percentile", price, 25),
            Metric("high", "percentile", price, 75),
        ],
    )


@query(
    "in_the_past_timestamp",
    """SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events
        WHERE ts >= TIMESTAMP '2024-01-18' AND ts < TIMESTAMP '2024-01-26' GROUP BY 1""",
)
def in_the_past_timestamp(t):
    window = in_the_past("ts", 7, "days", _ASOF)
    return metric_query(t.events, ["event_type"], [Metric("n", "count")], filters=[window])


@query(
    "metric_required",
    """SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events
        WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-11' AND DATE '2024-01-25' AND value > 10 GROUP BY 1""",
)
def metric_required(t):
    mart = staged_events(t).drop("partition_hourly")
    required = M.default_filter(mart, _ASOF)
    return metric_query(mart, ["event_type"], [Metric("n", "count")], filters=["value > 10"], required=required)


@query(
    "in_the_past_today",
    """SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1""",
)
def in_the_past_today(t):
    # A column of today's date lies within the last days, whatever the day is.
    rows = t.customer.withColumn("seen", F.current_date())
    return metric_query(rows, ["c_nationkey"], [Metric("n", "count")], filters=[in_the_past("seen", 3)])


@query(
    "default_intervals",
    """SELECT event_type, 'DAY DAY_OF_WEEK_NAME MONTH WEEK YEAR' AS offered FROM events GROUP BY 1""",
)
def default_intervals(t):
    mart = _mart(t)
    return mart.select("event_type", F.lit(" ".join(M.default_intervals(mart))).alias("offered")).distinct()
