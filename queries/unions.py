"""Unions, CTE chains, window expressions, order and limit."""

from pyspark.sql import functions as F

from lamella import (
    Join,
    Pages,
    dim,
    fct,
    grain,
    join_models,
    preview,
    rollup_model,
    select_model,
    union_models,
    with_roles,
)
from queries.base import WEEK, day, moment, query, staged_events, staged_orders


@query(
    "union_models",
    f"""
    SELECT o_custkey AS who, round(o_totalprice, 2) AS amount, {moment("o_orderdate")} AS datetime FROM orders
    WHERE o_totalprice > 100
    UNION ALL
    SELECT user_id, round(value, 2), {moment("ts")} FROM events WHERE value > 100
    """,
)
def union_both(t):
    orders = t.orders.selectExpr("o_custkey AS who", "o_totalprice AS amount", "o_orderdate AS datetime")
    events = t.events.selectExpr("user_id AS who", "value AS amount", "ts AS datetime")
    typed = [with_roles(df, facts=["amount"]) for df in (orders, events)]
    return union_models(typed, ["who", fct("amount")], where="amount > 100")


@query(
    "union_dates_expr",
    f"""
    SELECT event_type, 'both' AS origin, round(sum(value), 2) AS value_sum FROM (
        SELECT * FROM events UNION ALL SELECT * FROM events)
    WHERE CAST(ts AS DATE) BETWEEN '2024-01-05' AND '2024-01-11' GROUP BY event_type
    """,
)
def union_dates_expr(t):
    staged = staged_events(t)
    both = union_models([staged, staged], ["event_type", dim("origin", "'both'"), fct("value")], dates=WEEK)
    return select_model(both, ["event_type", "origin", fct("value", agg="sum")], row_count=False, inherit_time=False)


@query(
    "union_no_select",
    """SELECT c_custkey, c_name, c_nationkey FROM customer
        UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier""",
)
def union_no_select(t):
    suppliers = t.supplier.selectExpr(
        "s_acctbal", "s_nationkey AS c_nationkey", "s_name AS c_name", "s_suppkey AS c_custkey"
    )
    return union_models([t.customer.select("c_custkey", "c_name", "c_nationkey"), suppliers])


@query(
    "cte_chain",
    """
    WITH per_order AS (
        SELECT l_orderkey, sum(l_extendedprice) AS price_sum, count(*) AS line_count
        FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey HAVING count(*) >= 2),
    with_customer AS (
        SELECT o.o_custkey, p.price_sum, p.line_count FROM per_order p
        JOIN orders o ON p.l_orderkey = o.o_orderkey)
    SELECT o_custkey, round(sum(price_sum), 2) AS price_sum, CAST(sum(line_count) AS BIGINT) AS line_count
    FROM with_customer GROUP BY o_custkey
    """,
)
def cte_chain(t):
    per_order = select_model(
        t.lineitem,
        ["l_orderkey", fct("price", "l_extendedprice", agg="sum"), fct("line", "l_linenumber", agg="count")],
        where="l_returnflag <> 'N'",
        having="count(*) >= 2",
    )
    with_customer = join_models(
        ("p", per_order),
        [Join(t.orders, "o", [F.expr("p.l_orderkey = o.o_orderkey")])],
        [dim("o_custkey", side="o"), fct("price_sum"), fct("line_count")],
    )
    return select_model(
        with_customer, ["o_custkey", fct("price_sum", agg="sum"), fct("line_count", agg="count")]
    )


@query(
    "cte_group_dims",
    """
    SELECT year(o_orderdate) AS order_year, o_totalprice > 200000 AS large, CAST(count(*) AS BIGINT) AS n
    FROM orders GROUP BY 1, 2
    """,
)
def cte_group_dims(t):
    computed = [
        dim("order_year", "cast(year(o_orderdate) as bigint)"),
        dim("large", "o_totalprice > 200000"),
        fct("n", "count(*)"),
    ]
    return select_model(t.orders, computed, group_by="dims")


@query(
    "cte_union",
    """
    SELECT kind, CAST(count(*) AS BIGINT) AS n, round(sum(balance), 2) AS balance_sum FROM (
        SELECT 'customer' AS kind, c_acctbal AS balance FROM customer WHERE c_acctbal > 0
        UNION ALL SELECT 'supplier', s_acctbal FROM supplier WHERE s_acctbal > 0) GROUP BY kind
    """,
)
def cte_union(t):
    customers = select_model(
        t.customer, [dim("kind", "'customer'"), fct("balance", "c_acctbal")], where="c_acctbal > 0"
    )
    suppliers = select_model(
        t.supplier, [dim("kind", "'supplier'"), fct("balance", "s_acctbal")], where="s_acctbal > 0"
    )
    both = union_models([customers, suppliers])
    return select_model(both, ["kind", fct("balance", agg="sum"), fct("n", "count(*)")])


@query(
    "cte_passthrough",
    "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer",
)
def cte_passthrough(t):
    return select_model(select_model(t.customer))


@query(
    "cte_no_date_filter",
    "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type",
)
def cte_no_date_filter(t):
    whole = select_model(staged_events(t), dates=WEEK, exclude_date_filter=True)
    return select_model(
        whole, ["event_type", fct("n", "count(*)")], group_by="dims", inherit_time=False, row_count=False
    )


@query(
    "window_passthrough",
    f"""
    WITH monthly AS (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS total
        FROM orders GROUP BY 1, 2)
    SELECT o_orderpriority, {moment("m")} AS datetime, {day("m")} AS partition_monthly,
        round(sum(total) OVER (PARTITION BY o_orderpriority ORDER BY m), 2) AS running_total,
        CAST(rank() OVER (PARTITION BY o_orderpriority ORDER BY round(total, 2) DESC) AS BIGINT) AS month_rank
    FROM monthly
    """,
)
def window_passthrough(t):
    # The window runs over one row per priority and month, not over the orders themselves.
    monthly = select_model(
        staged_orders(t), ["o_orderpriority", grain("month"), fct("o_totalprice", agg="sum")]
    )
    over = "over (partition by o_orderpriority order by"
    return select_model(
        monthly,
        [
            "o_orderpriority",
            fct("running_total", f"sum(o_totalprice_sum) {over} datetime)"),
            fct("month_rank", f"cast(rank() {over} round(o_totalprice_sum, 2) desc) as bigint)"),
        ],
        row_count=False,
    )


@query(
    "order_limit_offset",
    """
    SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders
    ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100 OFFSET 20
    """,
)
def order_limit_offset(t):
    return select_model(
        t.orders,
        ["o_orderkey", fct("o_totalprice")],
        order_by=[("o_totalprice", "desc"), "o_orderkey"],
        limit=100,
        offset=20,
    )


@query(
    "top_groups",
    """
    SELECT o_custkey, round(sum(o_totalprice), 2) AS o_totalprice_sum FROM orders
    GROUP BY o_custkey ORDER BY round(sum(o_totalprice), 2) DESC, o_custkey LIMIT 25
    """,
)
def top_groups(t):
    return select_model(
        t.orders,
        ["o_custkey", fct("o_totalprice", agg="sum")],
        order_by=[("o_totalprice_sum", "desc"), "o_custkey"],
        limit=25,
    )


@query(
    "preview_first",
    "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100",
)
def preview_first(t):
    return preview(select_model(t.customer, ["c_custkey", "c_name"], order_by="c_custkey"))


@query(
    "union_rollup",
    f"""
    SELECT event_type, {moment("date_trunc('day', ts)")} AS datetime, {day("ts")} AS partition_daily,
        {day("date_trunc('month', ts)")} AS partition_monthly, round(sum(value), 2) AS value_sum,
        CAST(count(*) AS BIGINT) AS source_row_count
    FROM events GROUP BY ALL
    """,
)
def union_rollup(t):
    hourly = select_model(staged_events(t), ["event_type", grain("hour"), fct("value", agg="sum")])
    parts = [hourly.where("event_type = 'error'"), hourly.where("event_type <> 'error'")]
    return rollup_model(union_models(parts), "day")


@query(
    "page_deep",
    f"""
    SELECT l_orderkey, l_linenumber, {day("l_shipdate")} AS l_shipdate, round(l_extendedprice, 2) AS l_extendedprice
    FROM lineitem ORDER BY l_shipdate DESC NULLS LAST, l_orderkey, l_linenumber
    LIMIT 200 OFFSET (SELECT count(*) // 2 FROM lineitem)
    """,
)
def page_deep(t):
    """200 rows from the middle of all order lines, without the half before them."""
    lines = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "cast(l_shipdate as date) AS l_shipdate", "l_extendedprice")
    pages = Pages(lines, [("l_shipdate", "desc"), "l_orderkey", "l_linenumber"], ranges=40)
    return pages.page(pages.rows // 2, 200)


@query(
    "page_ties",
    """
    SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity
    FROM lineitem GROUP BY l_returnflag
    """,
)
def page_ties(t):
    """Pages of an order with three different keys hold every row once."""
    lines = t.lineitem.select("l_returnflag", "l_quantity", "l_orderkey", "l_linenumber")
    pages = Pages(lines, "l_returnflag", ranges=24)
    step = pages.rows // 5 + 1
    parts = [pages.page(at, step) for at in range(0, pages.rows, step)]
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    totals = [F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("quantity")]
    return found.groupBy("l_returnflag").agg(*totals)
