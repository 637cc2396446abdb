"""Conditions, subqueries, event-date filters."""

from pyspark.sql import functions as F

from lamella import (
    EventTime,
    PartitionDate,
    SourceSpec,
    all_true,
    any_true,
    compare,
    date_filter,
    exists,
    fct,
    is_in,
    not_exists,
    not_in,
    outer,
    parse_dates,
    read_source,
    select_model,
)
from lamella.operators.changes import date_profile
from lamella.operators.dates import column_type, in_dates, in_event_time, in_ranges, recorded_partitions
from queries.base import WEEK, day, query, staged_events, staged_orders

_ORDERS = "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders"
_PICK = ["o_orderkey", "o_custkey", fct("o_totalprice")]


@query("where_text", f"{_ORDERS} WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def where_text(t):
    return select_model(t.orders, _PICK, where="o_orderstatus = 'F' and o_totalprice > 200000")


@query(
    "where_nested",
    f"""{_ORDERS} WHERE o_orderstatus <> 'P' AND o_totalprice > 1000
        AND (o_orderpriority = '1-URGENT' OR (o_totalprice > 400000 AND o_orderstatus = 'F')
             OR (o_custkey < 10 OR o_custkey > 1400))""",
)
def where_nested(t):
    return select_model(
        t.orders,
        _PICK,
        where=all_true(
            "o_orderstatus <> 'P'",
            "o_totalprice > 1000",
            "",
            any_true(
                "o_orderpriority = '1-URGENT'",
                all_true("o_totalprice > 400000", "o_orderstatus = 'F'"),
                any_true("o_custkey < 10", "o_custkey > 1400"),
            ),
        ),
    )


_RICH = "SELECT c_custkey FROM customer WHERE c_acctbal > 5000"


@query("in_sub", f"{_ORDERS} WHERE o_custkey IN ({_RICH})")
def in_sub(t):
    return select_model(
        t.orders, _PICK, where=is_in("o_custkey", t.customer, "c_custkey", "c_acctbal > 5000")
    )


@query("not_in_sub", f"{_ORDERS} WHERE o_custkey NOT IN ({_RICH})")
def not_in_sub(t):
    return select_model(
        t.orders, _PICK, where=not_in("o_custkey", t.customer, "c_custkey", "c_acctbal > 5000")
    )


_NULLS = "SELECT CASE WHEN c_acctbal < 0 THEN NULL ELSE c_custkey END FROM customer"


@query(
    "not_in_sub_with_null",
    f"{_ORDERS} WHERE o_custkey NOT IN ({_NULLS}) OR o_orderstatus = 'P'",
)
def not_in_sub_with_null(t):
    maybe = "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_custkey END"
    return select_model(
        t.orders, _PICK, where=any_true(not_in("o_custkey", t.customer, maybe), "o_orderstatus = 'P'")
    )


@query(
    "in_sub_nested",
    f"{_ORDERS} WHERE o_totalprice > 450000 OR (o_custkey IN ({_RICH}) AND o_orderstatus = 'O')",
)
def in_sub_nested(t):
    rich = is_in("o_custkey", t.customer, "c_custkey", "c_acctbal > 5000")
    return select_model(
        t.orders, _PICK, where=any_true("o_totalprice > 450000", all_true(rich, "o_orderstatus = 'O'"))
    )


_BIG_LINE = "SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_extendedprice > o_totalprice / 4"


@query("exists_sub", f"{_ORDERS} WHERE EXISTS ({_BIG_LINE})")
def exists_sub(t):
    return select_model(t.orders, _PICK, where=exists(t.lineitem, _big_line()))


@query("not_exists_sub", f"{_ORDERS} WHERE NOT EXISTS ({_BIG_LINE})")
def not_exists_sub(t):
    return select_model(t.orders, _PICK, where=not_exists(t.lineitem, _big_line()))


def _big_line():
    return all_true(
        F.col("l_orderkey") == outer("o_orderkey"), F.col("l_extendedprice") > outer("o_totalprice") / 4
    )


def _scalar_query(op: str, sign: str):
    # The subquery's value is one that occurs, so that equality has something to find.
    @query(
        f"scalar_sub_{op}",
        f"{_ORDERS} WHERE o_custkey {sign} (SELECT max(c_custkey) - 100 FROM customer)",
    )
    def run(t):
        top = t.customer.agg((F.max("c_custkey") - 100).alias("edge"))
        return select_model(t.orders, _PICK, where=compare("o_custkey", op, top, "edge"))

    return run


for _op, _sign in (("eq", "="), ("neq", "<>"), ("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    _scalar_query(_op, _sign)


@query(
    "having_text",
    """
    SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS o_totalprice_sum
    FROM orders GROUP BY o_custkey HAVING count(*) > 10 AND sum(o_totalprice) > 2000000
    """,
)
def having_text(t):
    return select_model(
        t.orders,
        ["o_custkey", fct("n", "count(*)"), fct("o_totalprice", agg="sum")],
        having="count(*) > 10 and o_totalprice_sum > 2000000",
    )


@query(
    "having_sub",
    """
    SELECT o_custkey, round(sum(o_totalprice), 2) AS o_totalprice_sum FROM orders GROUP BY o_custkey
    HAVING sum(o_totalprice) > (SELECT avg(o_totalprice) * 12 FROM orders)
    """,
)
def having_sub(t):
    mean = t.orders.agg((F.avg("o_totalprice") * 12).alias("edge"))
    return select_model(
        t.orders,
        ["o_custkey", fct("o_totalprice", agg="sum")],
        having=compare("o_totalprice_sum", "gt", mean, "edge"),
    )


_EVENTS = "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events"


def _by_type(df):
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("event_date_in", f"{_EVENTS} WHERE CAST(ts AS DATE) IN ('2024-01-05', '2024-01-08') GROUP BY 1")
def event_date_in(t):
    daily = F.col("partition_daily")
    return _by_type(staged_events(t).where(in_dates(daily, parse_dates("2024-01-05,2024-01-08,2024-01-05"))))


@query(
    "event_date_range",
    f"{_EVENTS} WHERE ts >= '2024-01-05' AND ts < '2024-01-12' OR ts >= '2024-01-20' AND ts < '2024-01-21' GROUP BY 1",
)
def event_date_range(t):
    dates = [*parse_dates(WEEK), *parse_dates("2024-01-20")]
    return _by_type(t.events.where(in_ranges(F.col("ts"), dates, column_type(t.events, "ts"))))


@query(
    "event_datetime",
    f"{_EVENTS} WHERE date_trunc('day', CAST(ts AS DATE)) IN (DATE '2024-01-05', DATE '2024-01-07') GROUP BY 1",
)
def event_datetime(t):
    return _by_type(t.events.where(in_event_time(F.col("ts"), parse_dates("2024-01-05,2024-01-07"))))


@query(
    "month_filter",
    """SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders
        WHERE date_trunc('month', o_orderdate) IN (DATE '1996-02-01', DATE '1997-12-01') GROUP BY 1""",
)
def month_filter(t):
    dates = parse_dates("1996-02-29,1997-12-31")
    kept = t.orders.where(in_event_time(F.col("o_orderdate"), dates, grain="month"))
    return kept.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("full_month", f"{_EVENTS} WHERE date_trunc('month', ts) = DATE '2024-01-01' GROUP BY 1")
def full_month(t):
    return _by_type(date_filter(staged_events(t), "2024-01-31", include_full_month=True))


@query("date_filter_model", f"{_EVENTS} WHERE CAST(ts AS DATE) BETWEEN '2024-01-05' AND '2024-01-11' GROUP BY 1")
def date_filter_model(t):
    return _by_type(date_filter(staged_events(t), WEEK))


@query("date_filter_month_grain", f"{_EVENTS} WHERE date_trunc('month', ts) = DATE '2024-01-01' GROUP BY 1")
def date_filter_month_grain(t):
    return _by_type(date_filter(staged_events(t), WEEK, grain="month"))


@query("date_filter_no_daily", f"{_EVENTS} WHERE date_trunc('month', ts) = DATE '2024-01-01' GROUP BY 1")
def date_filter_no_daily(t):
    return _by_type(date_filter(staged_events(t), WEEK, exclude_daily_filter=True))


@query("date_filter_mart", f"{_EVENTS} GROUP BY 1")
def date_filter_mart(t):
    return _by_type(date_filter(staged_events(t), WEEK, layer="mart"))


# Events reach the store up to two days late, by their type; the store is partitioned by arrival.
_DELAY = "CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END"


def arrived(t):
    """Events with the day they were stored on."""
    return t.events.withColumn("arrived_on", F.expr(f"date_add(to_date(ts), {_DELAY})"))


LATE = SourceSpec("events", EventTime("ts"), PartitionDate("arrived_on"))
ARRIVED_SQL = f"SELECT *, CAST(ts AS DATE) + CAST({_DELAY} AS INTEGER) AS arrived_on FROM events"


def recorded(t):
    """What a scan of all events would have recorded for them."""
    return date_profile(arrived(t), LATE).select(F.lit("events").alias("source_id"), "*")


@query(
    "partition_dates_recorded",
    f"""
    WITH stored AS ({ARRIVED_SQL})
    SELECT DISTINCT {day("arrived_on")} AS partition_date FROM stored
    WHERE CAST(ts AS DATE) IN (DATE '2024-01-10', DATE '2024-01-20')
    """,
)
def partition_dates_recorded(t):
    return recorded_partitions(recorded(t), "events", "2024-01-10,2024-01-20")


@query(
    "partition_dates_fallback",
    "SELECT '2023-06-01' AS partition_date WHERE NOT EXISTS (SELECT 1 FROM events WHERE ts < '2023-06-02')",
)
def partition_dates_fallback(t):
    return recorded_partitions(recorded(t), "events", "2023-06-01")


def _late_sql():
    return f"""
    WITH stored AS ({ARRIVED_SQL})
    SELECT event_type, {day("arrived_on")} AS arrived_on, CAST(count(*) AS BIGINT) AS n FROM stored
    WHERE CAST(ts AS DATE) = DATE '2024-01-10' GROUP BY 1, 2
    """


@query("read_recorded_partitions", _late_sql())
def read_recorded_partitions(t):
    rows = read_source(arrived(t), LATE, "2024-01-10", source_dates=recorded(t))
    return rows.groupBy("event_type", "arrived_on").agg(F.count(F.lit(1)).alias("n"))


@query("read_recorded_partitions_runtime", _late_sql())
def read_recorded_partitions_runtime(t):
    spec = SourceSpec("events", EventTime("ts"), PartitionDate("arrived_on", compile_dates=False))
    rows = read_source(arrived(t), spec, "2024-01-10", source_dates=recorded(t))
    return rows.groupBy("event_type", "arrived_on").agg(F.count(F.lit(1)).alias("n"))


def _recorded_range_sql():
    return f"""
    WITH stored AS ({ARRIVED_SQL})
    SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM stored
    WHERE CAST(ts AS DATE) IN (DATE '2024-01-10', DATE '2024-01-20') GROUP BY 1
    """


def _recorded_range(t, **options):
    """Arrival as a time within its day: a recorded day stands for all of it."""
    at = F.col("arrived_on").cast("timestamp_ntz") + F.expr("make_dt_interval(0, hour(ts), minute(ts))")
    spec = SourceSpec("events", EventTime("ts"), PartitionDate("arrived_at", use_range=True, **options))
    rows = arrived(t).withColumn("arrived_at", at)
    rows = read_source(rows, spec, "2024-01-10,2024-01-20", source_dates=recorded(t))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("read_recorded_range", _recorded_range_sql())
def read_recorded_range(t):
    return _recorded_range(t)


@query("read_recorded_range_runtime", _recorded_range_sql())
def read_recorded_range_runtime(t):
    return _recorded_range(t, compile_dates=False)


@query(
    "read_recorded_month",
    """SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders
        WHERE CAST(o_orderdate AS DATE) = DATE '1996-05-17' GROUP BY 1""",
)
def read_recorded_month(t):
    # Nothing is recorded, so the run's own date stands for its month, which is what the source is stored by.
    part = PartitionDate("trunc(o_orderdate, 'month')", grain="month")
    nothing = recorded(t).where("false")
    rows = read_source(t.orders, SourceSpec("orders", EventTime("o_orderdate"), part), "1996-05-17", source_dates=nothing)
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "full_month_of_many",
    """SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders
        WHERE date_trunc('month', o_orderdate) IN (DATE '1996-02-01', DATE '1997-11-01') GROUP BY 1""",
)
def full_month_of_many(t):
    staged = staged_orders(t)
    found = date_filter(staged, "1996-02-29,1997-11-01", include_full_month=True)
    return found.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dates_and_where",
    """SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders
        WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-27' AND DATE '1996-03-02' AND o_totalprice > 100000""",
)
def dates_and_where(t):
    picked = ["o_orderkey", fct("o_totalprice")]
    found = select_model(staged_orders(t), picked, dates="1996-02-27~1996-03-02", where="o_totalprice > 100000")
    return found.select("o_orderkey", "o_totalprice")


_MONTHS_OF_ORDERS = """
    SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders
    WHERE date_trunc('month', o_orderdate) = DATE '1996-02-01' GROUP BY 1"""


@query("date_filter_month_of_orders", _MONTHS_OF_ORDERS)
def date_filter_month_of_orders(t):
    found = date_filter(staged_orders(t), "1996-02-10", grain="month")
    return found.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("date_filter_no_daily_of_orders", _MONTHS_OF_ORDERS)
def date_filter_no_daily_of_orders(t):
    found = date_filter(staged_orders(t), "1996-02-10", exclude_daily_filter=True)
    return found.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
