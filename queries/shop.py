"""The example shop's models, rebuilt on the given tables: staging, intermediate, marts."""

from pyspark.sql import functions as F

from lamella import (
    EventTime,
    Join,
    SourceSpec,
    all_from,
    dim,
    dims_from,
    fct,
    join_models,
    lookback_model,
    rollup_model,
    select_model,
    stage_source,
    union_models,
)
from lamella.functions import scalars as S
from queries.base import day, moment, query


def customers(t):
    """Customers with their name in parts."""
    words = S.split_text(F.trim("c_name"), "#")
    last = F.when(S.cardinality(words) > 1, S.element(words, S.cardinality(words)))
    return stage_source(
        t.customer,
        SourceSpec("customer"),
        [
            dim("customer_id", "c_custkey"),
            dim("customer_first_name", S.element(words, 1)),
            dim("customer_last_name", last),
            dim("customer_name", "trim(c_name)"),
            dim("segment", "c_mktsegment"),
        ],
    )


def orders(t):
    return stage_source(
        t.orders,
        SourceSpec("orders", EventTime("o_orderdate")),
        [
            dim("order_id", "o_orderkey"),
            dim("customer_id", "o_custkey"),
            dim("order_date", "to_date(o_orderdate)"),
            dim("priority", "o_orderpriority"),
            fct("order_total_cents", "cast(round(o_totalprice * 100) as bigint)"),
        ],
    )


def enriched(t, **options):
    """Orders with their customer."""
    return join_models(
        ("orders", orders(t)),
        [Join(customers(t), "customers", ["customer_id"], "left")],
        [
            all_from("orders"),
            dims_from("customers", include=["customer_name", "segment"]),
            fct("order_total_dollars", "cast(orders.order_total_cents as decimal(20,2)) / 100.0"),
        ],
        **options,
    )


@query(
    "shop_customers",
    """
    SELECT c_custkey AS customer_id, string_split(trim(c_name), '#')[1] AS customer_first_name,
        CASE WHEN len(string_split(trim(c_name), '#')) > 1
            THEN string_split(trim(c_name), '#')[len(string_split(trim(c_name), '#'))] END AS customer_last_name,
        trim(c_name) AS customer_name, c_mktsegment AS segment, 1 AS source_row_count FROM customer
    """,
)
def shop_customers(t):
    return customers(t)


@query(
    "shop_orders_enriched",
    f"""
    SELECT o_orderkey AS order_id, o_custkey AS customer_id, {day("o_orderdate")} AS order_date,
        o_orderpriority AS priority, CAST(round(o_totalprice * 100) AS BIGINT) AS order_total_cents,
        round(o_totalprice, 2) AS order_total_dollars, c_name AS customer_name, c_mktsegment AS segment,
        1 AS source_row_count, {moment("o_orderdate")} AS datetime, {day("o_orderdate")} AS partition_daily,
        {moment("date_trunc('hour', o_orderdate)")} AS partition_hourly,
        {day("date_trunc('month', o_orderdate)")} AS partition_monthly
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    """,
)
def shop_orders_enriched(t):
    return enriched(t)


@query(
    "shop_customer_summary",
    """
    SELECT c_custkey AS customer_id, trim(c_name) AS customer_name, CAST(count(o_orderkey) AS BIGINT) AS total_orders,
        CASE WHEN count(o_orderkey) >= 10 THEN 'VIP' WHEN count(o_orderkey) >= 3 THEN 'Regular' ELSE 'New'
            END AS customer_segment,
        CAST(count(*) AS BIGINT) AS source_row_count, contains(c_name, '#') AS has_last_name
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name
    """,
)
def shop_customer_summary(t):
    count = "count(orders.order_id)"
    tier = f"case when {count} >= 10 then 'VIP' when {count} >= 3 then 'Regular' else 'New' end"
    return join_models(
        ("customers", customers(t)),
        [Join(orders(t), "orders", ["customer_id"], "left")],
        [
            "customer_id",
            "customer_name",
            dim("has_last_name", "customers.customer_last_name is not null"),
            dim("customer_segment", tier, exclude_from_group_by=True),
            fct("total_orders", count),
        ],
        group_by="dims",
    )


@query(
    "shop_product_popularity",
    """
    SELECT l_partkey, p_type, CAST(count(*) AS BIGINT) AS total_items_sold,
        CAST(count(DISTINCT l_orderkey) AS BIGINT) AS total_orders
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
    """,
)
def shop_product_popularity(t):
    return join_models(
        ("lines", t.lineitem),
        [Join(t.part, "part", [F.expr("lines.l_partkey = part.p_partkey")])],
        [
            "l_partkey",
            dim("p_type", side="part"),
            fct("total_items_sold", "count(*)"),
            fct("total_orders", "count(distinct lines.l_orderkey)"),
        ],
        group_by="dims",
    )


@query(
    "shop_regional_combined",
    """
    SELECT CASE WHEN segment IN ('BUILDING', 'FURNITURE') THEN 'Home' WHEN segment = 'MACHINERY' THEN 'Works'
        ELSE 'Other' END AS region, CAST(2 * count(*) AS BIGINT) AS orders,
        round(2 * sum(o_totalprice), 2) AS order_total_dollars_sum
    FROM (SELECT o_totalprice, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
    GROUP BY 1
    """,
)
def shop_regional_combined(t):
    region = """case when segment in ('BUILDING', 'FURNITURE') then 'Home'
        when segment = 'MACHINERY' then 'Works' else 'Other' end"""
    both = union_models(
        [enriched(t), enriched(t)], [all_from(exclude=["segment"]), dim("region", region)]
    )
    totals = ["region", fct("orders", "count(*)"), fct("order_total_dollars", agg="sum")]
    return select_model(both, totals, inherit_time=False, row_count=False)


@query(
    "shop_monthly_revenue",
    f"""
    SELECT o_orderpriority AS priority, {moment("date_trunc('month', o_orderdate)")} AS datetime,
        {day("date_trunc('month', o_orderdate)")} AS partition_monthly,
        round(sum(o_totalprice), 2) AS order_total_dollars_sum, CAST(count(*) AS BIGINT) AS source_row_count
    FROM orders GROUP BY ALL
    """,
)
def shop_monthly_revenue(t):
    daily = select_model(enriched(t), ["priority", fct("order_total_dollars", agg="sum")])
    return rollup_model(daily, "month")


@query(
    "shop_rolling_30_day",
    f"""
    WITH dates AS (SELECT CAST(unnest(generate_series(DATE '1998-01-01', DATE '1998-03-31', INTERVAL 1 DAY)) AS DATE) AS e)
    SELECT o_orderpriority AS priority, {day("e")} AS partition_daily, CAST(count(o_orderkey) AS BIGINT) AS order_id_count,
        round(sum(o_totalprice), 2) AS order_total_dollars_sum, round(min(o_totalprice), 2) AS order_total_dollars_min,
        round(max(o_totalprice), 2) AS order_total_dollars_max
    FROM dates JOIN orders ON CAST(o_orderdate AS DATE) <= e AND CAST(o_orderdate AS DATE) >= e - 30
    GROUP BY o_orderpriority, e
    """,
)
def shop_rolling_30_day(t):
    return lookback_model(
        enriched(t),
        "1998-01-01~1998-03-31",
        30,
        ["priority", fct("order_id", agg="count"), fct("order_total_dollars", aggs=["sum", "min", "max"])],
    )


@query(
    "shop_revenue_mart",
    f"""
    SELECT o_orderkey AS order_id, isodow(o_orderdate) IN (6, 7) AS is_weekend_order,
        CAST(month(o_orderdate) AS INTEGER) AS order_month, CAST(quarter(o_orderdate) AS INTEGER) AS order_quarter,
        CAST(year(o_orderdate) AS INTEGER) AS order_year,
        CASE WHEN o_totalprice >= 300000 THEN 'High' WHEN o_totalprice >= 100000 THEN 'Medium' ELSE 'Low'
            END AS revenue_tier, round(o_totalprice, 2) AS total_dollars
    FROM orders
    """,
)
def shop_revenue_mart(t):
    tier = """case when order_total_dollars >= 300000 then 'High'
        when order_total_dollars >= 100000 then 'Medium' else 'Low' end"""
    return select_model(
        enriched(t),
        [
            "order_id",
            dim("is_weekend_order", S.day_of_week("order_date").isin(6, 7)),
            dim("order_month", "extract(month from order_date)"),
            dim("order_quarter", "extract(quarter from order_date)"),
            dim("order_year", "extract(year from order_date)"),
            dim("revenue_tier", tier),
            fct("total_dollars", "order_total_dollars"),
        ],
        layer="mart",
        inherit_time=False,
        row_count=False,
    )


@query(
    "shop_profitability_mart",
    f"""
    SELECT {day("o_orderdate")} AS order_date, {day("date_trunc('month', o_orderdate)")} AS order_year_month,
        o_orderpriority AS priority, round(avg(o_totalprice), 6) AS avg_order_value_dollars,
        CAST(count(*) AS BIGINT) AS order_count, round(sum(o_totalprice), 6) AS revenue_per_day,
        CAST(count(*) AS BIGINT) AS source_row_count
    FROM orders GROUP BY ALL
    """,
    digits=6,
)
def shop_profitability_mart(t):
    return select_model(
        enriched(t),
        [
            "order_date",
            dim("order_year_month", S.trunc_date("month", "order_date")),
            "priority",
            fct("avg_order_value_dollars", "avg(cast(order_total_dollars as double))"),
            fct("order_count", "count(*)"),
            fct("revenue_per_day", "sum(order_total_dollars)"),
        ],
        group_by="dims",
        layer="mart",
        inherit_time=False,
    )


def cost_efficiency(t):
    """Parts with how their price compares to what is charged for them."""
    cost = join_models(
        ("lines", select_model(t.lineitem, ["l_partkey", fct("l_extendedprice", agg="max")])),
        [Join(t.part, "part", [F.expr("lines.l_partkey = part.p_partkey")], "left")],
        [
            "l_partkey",
            dim("p_brand", side="part"),
            fct("ratio", "part.p_retailprice / lines.l_extendedprice_max"),
        ],
    )
    category = """case when ratio <= 0.0102 then 'Highly Efficient' when ratio <= 0.0150 then 'Efficient'
        when ratio <= 0.0180 then 'Moderate' else 'Low Efficiency' end"""
    return select_model(cost, ["l_partkey", "p_brand", dim("category", category)], layer="mart")


@query(
    "shop_comprehensive_mart",
    """
    WITH e AS (SELECT l_partkey, p_brand, CASE WHEN r <= 0.0102 THEN 'Highly Efficient' WHEN r <= 0.0150 THEN 'Efficient'
            WHEN r <= 0.0180 THEN 'Moderate' ELSE 'Low Efficiency' END AS category
        FROM (SELECT l_partkey, p_brand, p_retailprice / max(l_extendedprice) AS r
            FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_partkey, p_brand, p_retailprice)),
    m AS (SELECT l_partkey, count(*) AS sold FROM lineitem GROUP BY l_partkey)
    SELECT m.l_partkey, e.p_brand, CAST(m.sold AS BIGINT) AS total_items_sold,
        CASE e.category WHEN 'Highly Efficient' THEN 100 WHEN 'Efficient' THEN 85 WHEN 'Moderate' THEN 70
            ELSE 50 END AS business_impact_score
    FROM m LEFT JOIN e ON m.l_partkey = e.l_partkey
    """,
)
def shop_comprehensive_mart(t):
    score = """case when e.category = 'Highly Efficient' then 100 when e.category = 'Efficient' then 85
        when e.category = 'Moderate' then 70 else 50 end"""
    menu = select_model(t.lineitem, ["l_partkey", fct("total_items_sold", "count(*)")], group_by="dims")
    return join_models(
        ("m", menu),
        [Join(cost_efficiency(t), "e", ["l_partkey"], "left")],
        ["l_partkey", dim("p_brand", side="e"), fct("total_items_sold"), dim("business_impact_score", score)],
        layer="mart",
    )
