"""Sources: staging, source unions, static filters, refresh from a parent."""

from pyspark.sql import functions as F

from lamella import (
    EventTime,
    PartitionDate,
    PartitionPredicate,
    SourceSpec,
    fct,
    read_source,
    refresh_from_parent,
    select_model,
    stage_source,
    stage_union,
)
from queries.base import ORDERS, WEEK, day, moment, query, staged_events

_TIMES = f"""
    {moment("ts")} AS datetime,
    {day("ts")} AS partition_daily,
    {moment("date_trunc('hour', ts)")} AS partition_hourly,
    {day("date_trunc('month', ts)")} AS partition_monthly,
    1 AS source_row_count
"""


@query(
    "stage_events",
    f"""
    SELECT event_id, user_id, event_type, round(value, 2) AS value, {_TIMES}
    FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-11'
    """,
)
def stage_events(t):
    return staged_events(t, WEEK)


@query(
    "stage_events_full_month",
    """
    SELECT event_type, CAST(count(*) AS BIGINT) AS source_row_count, round(sum(value), 2) AS value_sum
    FROM events WHERE date_trunc('month', ts) = DATE '2024-01-01'
    GROUP BY event_type
    """,
)
def stage_events_full_month(t):
    month = staged_events(t, "2024-01-17", include_full_month=True)
    return select_model(month, ["event_type", fct("value", agg="sum")], inherit_time=False)


@query(
    "stage_no_row_count",
    """SELECT event_id, user_id, event_type, round(value, 2) AS value,
        strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS datetime FROM events""",
)
def stage_no_row_count(t):
    return staged_events(t, row_count=False, partition_columns=False)


@query(
    "stage_union_orders",
    f"""
    SELECT o_orderkey, o_orderpriority, round(o_totalprice, 2) AS o_totalprice,
        {moment("o_orderdate")} AS datetime,
        {day("o_orderdate")} AS partition_daily,
        {moment("date_trunc('hour', o_orderdate)")} AS partition_hourly,
        {day("date_trunc('month', o_orderdate)")} AS partition_monthly,
        1 AS source_row_count
    FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice > 100000
    """,
)
def stage_union_orders(t):
    done = SourceSpec("orders_done", ORDERS.event_time, where="o_orderstatus = 'F'")
    part = SourceSpec("orders_part", ORDERS.event_time, where="o_orderstatus = 'P'")
    select = ["o_orderkey", "o_orderpriority", fct("o_totalprice")]
    return stage_union([(t.orders, done), (t.orders, part)], select, where="o_totalprice > 100000")


@query(
    "stage_union_no_select",
    """
    SELECT c_custkey AS key, c_name AS name, 1 AS source_row_count FROM customer
    UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier
    """,
)
def stage_union_no_select(t):
    customers = t.customer.selectExpr("c_custkey AS key", "c_name AS name")
    suppliers = t.supplier.selectExpr("s_name AS name", "s_suppkey AS key", "s_acctbal")
    return stage_union([(customers, SourceSpec("customer")), (suppliers, SourceSpec("supplier"))])


def _partition_query(kind: str, sign: str):
    @query(
        f"partition_{kind}",
        f"""
        SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS l_quantity_sum
        FROM lineitem WHERE l_shipdate {sign} TIMESTAMP '1998-09-02' GROUP BY l_returnflag
        """,
    )
    def run(t):
        spec = SourceSpec(
            "lineitem", partitions=(PartitionPredicate("l_shipdate", kind, "1998-09-02"),), row_count=False
        )
        rows = read_source(t.lineitem, spec)
        return select_model(
            rows, ["l_returnflag", fct("n", "count(*)"), fct("l_quantity", agg="sum")], row_count=False
        )

    return run


for _kind, _sign in (("eq", "="), ("neq", "<>"), ("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    _partition_query(_kind, _sign)


@query(
    "partition_event_dates",
    """
    SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events
    WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' GROUP BY event_type
    """,
)
def partition_event_dates(t):
    spec = SourceSpec("events", partitions=(PartitionPredicate("ts", "event_dates", use_range=True),))
    return read_source(t.events, spec, WEEK).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "partition_date_text",
    f"""
    SELECT {day("ts")} AS load_day, CAST(count(*) AS BIGINT) AS n FROM events
    WHERE CAST(ts AS DATE) IN (DATE '2024-01-05', DATE '2024-01-09') GROUP BY 1
    """,
)
def partition_date_text(t):
    loaded = t.events.withColumn("load_day", F.date_format("ts", "yyyy-MM-dd"))
    spec = SourceSpec(
        "events", EventTime("ts"), PartitionDate("load_day", data_type="varchar", use_event_dates=True)
    )
    rows = read_source(loaded, spec, "2024-01-05,2024-01-09,2024-01-05")
    return rows.groupBy("load_day").agg(F.count(F.lit(1)).alias("n"))


@query(
    "spec_override",
    """
    SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(max(value), 2) AS value_max
    FROM events WHERE value > 50 GROUP BY event_type
    """,
)
def spec_override(t):
    schema_wide = SourceSpec(event_time=EventTime("ts", grain="day"), where="value > 0", row_count=True)
    spec = schema_wide.override(SourceSpec("events", where="value > 50", row_count=False))
    rows = stage_source(t.events, spec, ["event_type", fct("value")])
    return select_model(rows, ["event_type", fct("n", "count(*)"), fct("value", agg="max")], inherit_time=False)


@query(
    "refresh_parent",
    f"""
    SELECT o_orderkey AS order_id, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
        {day("o_orderdate")} AS ordered_on
    FROM orders WHERE o_orderstatus = 'O'
    """,
)
def refresh_parent(t):
    return refresh_from_parent(
        t.orders,
        [
            ("order_id", "o_orderkey", None),
            ("cents", "round(o_totalprice * 100)", "bigint"),
            ("ordered_on", "o_orderdate", "date"),
        ],
        "o_orderstatus = 'O'",
    )


