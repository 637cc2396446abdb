"""Select lists, bulk selection, column order, time grains."""

from pyspark.sql import functions as F

from lamella import (
    all_from,
    dim,
    dims_from,
    facts_from,
    fct,
    grain,
    partition_columns,
    select_model,
    with_roles,
)
from queries.base import day, moment, query, staged_events, staged_orders

_FACTS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines(t):
    return with_roles(t.lineitem, facts=_FACTS)


@query(
    "bulk_select_dims",
    f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus,
        {moment("l_shipdate")} AS l_shipdate FROM lineitem""",
)
def bulk_select_dims(t):
    return select_model(_lines(t), [dims_from()])


@query(
    "bulk_select_facts",
    """SELECT round(l_quantity, 2) AS l_quantity, round(l_extendedprice, 2) AS l_extendedprice,
        round(l_discount, 2) AS l_discount, round(l_tax, 2) AS l_tax FROM lineitem""",
)
def bulk_select_facts(t):
    return select_model(_lines(t), [facts_from()])


@query(
    "bulk_include_exclude",
    """SELECT l_orderkey, l_linenumber, l_returnflag, round(l_quantity, 2) AS l_quantity,
        round(l_tax, 2) AS l_tax FROM lineitem""",
)
def bulk_include_exclude(t):
    keep = dims_from(include=["l_orderkey", "l_linenumber", "l_returnflag"])
    return select_model(_lines(t), [keep, facts_from(exclude=["l_extendedprice", "l_discount"])])


@query("bulk_select_all", "SELECT event_id, event_type, user_id, props FROM events")
def bulk_select_all(t):
    return select_model(t.events, [all_from(exclude=["ts", "value"])])


@query(
    "select_expressions",
    """SELECT c_custkey, upper(c_mktsegment) AS segment, round(c_acctbal * 2, 2) AS doubled,
        c_acctbal < 0 AS overdrawn FROM customer""",
)
def select_expressions(t):
    return select_model(
        t.customer,
        [
            "c_custkey",
            dim("segment", "upper(c_mktsegment)"),
            fct("doubled", F.col("c_acctbal") * 2),
            dim("overdrawn", "c_acctbal < 0"),
        ],
    )


@query(
    "select_first_wins",
    "SELECT p_partkey, lower(p_type) AS p_type, p_size FROM part",
)
def select_first_wins(t):
    # The later, plain p_type and p_size give way to the ones already selected.
    first = ["p_partkey", dim("p_type", "lower(p_type)"), "p_size"]
    return select_model(t.part, [*first, all_from(include=["p_type", "p_size"])])


@query(
    "custom_partitions",
    f"""SELECT o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice_sum, o_orderstatus
        FROM orders GROUP BY o_orderpriority, o_orderstatus""",
)
def custom_partitions(t):
    own = partition_columns(model=["o_orderstatus"])
    return select_model(
        t.orders, ["o_orderstatus", "o_orderpriority", fct("o_totalprice", agg="sum")], partitions=own
    )


def _grain_query(interval: str):
    partitions = {
        "hour": f", {moment("date_trunc('hour', ts)")} AS partition_hourly, {day('ts')} AS partition_daily"
        f", {day("date_trunc('month', ts)")} AS partition_monthly",
        "day": f", {day('ts')} AS partition_daily, {day("date_trunc('month', ts)")} AS partition_monthly",
        "month": f", {day("date_trunc('month', ts)")} AS partition_monthly",
        "year": "",
    }[interval]

    @query(
        f"grain_{interval}",
        f"""
        SELECT event_type, {moment(f"date_trunc('{interval}', ts)")} AS datetime{partitions},
            round(sum(value), 2) AS value_sum, CAST(count(*) AS BIGINT) AS source_row_count
        FROM events GROUP BY ALL
        """,
    )
    def run(t):
        return select_model(staged_events(t), ["event_type", grain(interval), fct("value", agg="sum")])

    return run


for _interval in ("hour", "day", "month", "year"):
    _grain_query(_interval)


@query(
    "grain_month_orders",
    f"""
    SELECT o_orderstatus, {moment("date_trunc('month', o_orderdate)")} AS datetime,
        {day("date_trunc('month', o_orderdate)")} AS partition_monthly,
        round(sum(o_totalprice), 2) AS o_totalprice_sum, CAST(count(*) AS BIGINT) AS source_row_count
    FROM orders GROUP BY ALL
    """,
)
def grain_month_orders(t):
    return select_model(staged_orders(t), ["o_orderstatus", grain("month"), fct("o_totalprice", agg="sum")])
