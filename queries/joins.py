"""Joins of every kind, and unnesting."""

from pyspark.sql import functions as F

from lamella import Between, Join, dim, fct, grain, is_in, join_models, select_model, unnest_model, with_roles
from lamella.operators.select import all_from
from queries.base import WEEK, day, moment, query, staged_events

def _on_customer():
    return F.expr("o.o_custkey = c.c_custkey")


def _segments(t, how, narrow=True, **options):
    """Orders and customers; outer joins narrow both sides, so that each has rows without a match."""
    orders, customer = t.orders, t.customer
    if narrow:
        orders, customer = orders.where("o_totalprice > 50000"), customer.where("c_acctbal > 5000")
    return join_models(
        ("o", orders),
        [Join(customer, "c", [_on_customer()], how, **options)],
        [
            "o_orderstatus",
            dim("c_mktsegment", side="c"),
            fct("n", "count(*)"),
            fct("o_totalprice", agg="sum"),
            fct("c_acctbal", agg="max", side="c"),
        ],
    )


def _segments_sql(how, orders="WHERE o_totalprice > 50000", customer="WHERE c_acctbal > 5000"):
    return f"""
    SELECT o_orderstatus, c_mktsegment, CAST(count(*) AS BIGINT) AS n,
        round(sum(o_totalprice), 2) AS o_totalprice_sum, round(max(c_acctbal), 2) AS c_acctbal_max
    FROM (SELECT * FROM orders {orders}) o
    {how} JOIN (SELECT * FROM customer {customer}) c ON o.o_custkey = c.c_custkey
    GROUP BY o_orderstatus, c_mktsegment
    """


@query("join_inner", _segments_sql("INNER", "", ""))
def join_inner(t):
    return _segments(t, "inner", narrow=False)


@query("join_left", _segments_sql("LEFT"))
def join_left(t):
    return _segments(t, "left")


@query("join_right", _segments_sql("RIGHT"))
def join_right(t):
    return _segments(t, "right")


@query("join_full", _segments_sql("FULL"))
def join_full(t):
    return _segments(t, "full")


@query("join_full_plain", _segments_sql("FULL"))
def join_full_plain(t):
    return _segments(t, "full", skewed=False)


@query("join_full_split", _segments_sql("FULL"))
def join_full_split(t):
    return _segments(t, "full", skewed=True)


@query(
    "join_full_skewed",
    """
    SELECT o.o_orderstatus, c.c_mktsegment, CAST(count(*) AS BIGINT) AS n, CAST(count(o.o_orderkey) AS BIGINT) AS orders,
        round(sum(o.o_totalprice), 2) AS o_totalprice_sum, round(max(c.c_acctbal), 2) AS c_acctbal_max
    FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 1 WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_custkey END AS key
          FROM orders) o
    FULL JOIN (SELECT *, c_custkey AS key FROM customer) c ON o.key = c.key
    GROUP BY o.o_orderstatus, c.c_mktsegment
    """,
)
def join_full_skewed(t):
    """Half of all orders belong to one customer, some to none."""
    key = "CASE WHEN o_orderkey % 2 = 0 THEN 1 WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_custkey END"
    orders = t.orders.withColumn("key", F.expr(key))
    customer = t.customer.withColumn("key", F.col("c_custkey"))
    return join_models(
        ("o", orders),
        [Join(customer, "c", ["key"], "full", skewed=True)],
        [
            "o_orderstatus",
            dim("c_mktsegment", side="c"),
            fct("n", "count(*)"),
            fct("orders", "count(o.o_orderkey)"),
            fct("o_totalprice", agg="sum"),
            fct("c_acctbal", agg="max", side="c"),
        ],
    )


def _bands(t):
    """What a customer may spend: a band of prices whose width differs from customer to customer."""
    low = "c_acctbal * 20"
    return t.customer.selectExpr(
        "c_custkey", "c_mktsegment", "c_nationkey", f"{low} AS low", f"{low} + 10 + (c_custkey % 7) * 100 AS high"
    )


def _bands_sql(how, on="", where=""):
    return f"""
    SELECT o.o_orderstatus, c.c_mktsegment, CAST(count(*) AS BIGINT) AS n, CAST(count(o.o_orderkey) AS BIGINT) AS orders,
        CAST(count(c.c_custkey) AS BIGINT) AS customers, round(max(o.o_totalprice), 2) AS o_totalprice_max
    FROM (SELECT *, o_orderkey % 25 AS nation FROM orders {where}) o {how} JOIN
        (SELECT *, c_acctbal * 20 AS low, c_acctbal * 20 + 10 + (c_custkey % 7) * 100 AS high FROM customer) c
        ON o.o_totalprice BETWEEN c.low AND c.high {on}
    GROUP BY o.o_orderstatus, c.c_mktsegment
    """


def _in_bands(t, how, on=(), where="true"):
    orders = t.orders.where(where).withColumn("nation", F.expr("o_orderkey % 25"))
    return join_models(
        ("o", orders),
        [Join(_bands(t), "c", on, how, between=Between("o.o_totalprice", "c.low", "c.high"))],
        [
            "o_orderstatus",
            dim("c_mktsegment", side="c"),
            fct("n", "count(*)"),
            fct("orders", "count(o.o_orderkey)"),
            fct("customers", "count(c.c_custkey)"),
            fct("o_totalprice", agg="max"),
        ],
    )


@query("join_interval", _bands_sql("INNER"))
def join_interval(t):
    return _in_bands(t, "inner")


@query("join_interval_left", _bands_sql("LEFT"))
def join_interval_left(t):
    return _in_bands(t, "left")


@query("join_interval_full", _bands_sql("FULL"))
def join_interval_full(t):
    return _in_bands(t, "full")


@query("join_interval_keys", _bands_sql("RIGHT", "AND o.nation = c.c_nationkey"))
def join_interval_keys(t):
    """An equality beside the interval; rows of the right side are kept."""
    return _in_bands(t, "right", [F.expr("o.nation = c.c_nationkey")])


@query(
    "join_interval_days",
    """
    SELECT o.o_orderpriority, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT l.l_orderkey) AS BIGINT) AS lines
    FROM (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS opened, CAST(o_orderdate AS DATE) + 3 AS closed
          FROM orders WHERE o_orderstatus = 'P') o
    JOIN (SELECT l_orderkey, CAST(l_shipdate AS DATE) AS shipped FROM lineitem WHERE l_quantity < 3) l
        ON l.shipped BETWEEN o.opened AND o.closed
    GROUP BY o.o_orderpriority
    """,
)
def join_interval_days(t):
    """Intervals of days on the base, the point on the joined side."""
    opened = t.orders.where("o_orderstatus = 'P'").selectExpr(
        "o_orderpriority", "cast(o_orderdate as date) AS opened", "date_add(cast(o_orderdate as date), 3) AS closed"
    )
    lines = t.lineitem.where("l_quantity < 3").selectExpr("l_orderkey", "cast(l_shipdate as date) AS shipped")
    within = Between("l.shipped", "o.opened", "o.closed")
    return join_models(
        ("o", opened),
        [Join(lines, "l", between=within)],
        ["o_orderpriority", fct("n", "count(*)"), fct("lines", "count(distinct l.l_orderkey)")],
        inherit_time=False,
    )


@query(
    "join_by_names",
    """
    SELECT n.key AS key, n.n_name, s.s_name FROM
        (SELECT n_nationkey AS key, n_name FROM nation) n
        LEFT JOIN (SELECT s_nationkey AS key, s_name FROM supplier) s ON n.key = s.key
    """,
)
def join_by_names(t):
    nations = t.nation.selectExpr("n_nationkey AS key", "n_name")
    suppliers = t.supplier.selectExpr("s_nationkey AS key", "s_name")
    return join_models(
        ("n", nations), [Join(suppliers, "s", ["key"], "left")], ["key", "n_name", dim("s_name", side="s")]
    )


@query(
    "join_theta",
    """
    SELECT o.o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders o
    INNER JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 50
    GROUP BY o.o_orderstatus
    """,
)
def join_theta(t):
    return join_models(
        ("o", t.orders),
        [Join(t.customer, "c", [_on_customer(), F.expr("o.o_totalprice > c.c_acctbal * 50")])],
        ["o_orderstatus", fct("n", "count(*)")],
        group_by=["o_orderstatus"],
    )


@query(
    "join_dims",
    """
    SELECT a.event_type, a.user_id, round(a.value_sum, 2) AS value_sum, b.value_count FROM
        (SELECT event_type, user_id, sum(value) AS value_sum FROM events
            WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1, 2) a
        INNER JOIN (SELECT event_type, user_id, CAST(count(value) AS BIGINT) AS value_count FROM events
            WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1, 2) b
        ON a.event_type = b.event_type AND a.user_id = b.user_id
    """,
)
def join_dims(t):
    typed = with_roles(t.events, facts=["value"])
    first = select_model(
        typed, ["event_type", "user_id", fct("value", agg="sum")], where="ts < timestamp_ntz'2024-01-16'"
    )
    second = select_model(
        typed, ["event_type", "user_id", fct("value", agg="count")], where="ts >= timestamp_ntz'2024-01-16'"
    )
    return join_models(
        ("a", first),
        [Join(second, "b", "dims")],
        ["event_type", "user_id", fct("value_sum"), fct("value_count", side="b")],
    )


@query(
    "join_alias",
    """
    SELECT a.event_id, a.event_type, b.event_type AS next_type FROM events a
    LEFT JOIN events b ON b.event_id = a.event_id + 1
    """,
)
def join_alias(t):
    on = [F.expr("b.event_id = a.event_id + 1")]
    pick = ["event_id", "event_type", dim("next_type", "b.event_type")]
    return join_models(("a", t.events), [Join(t.events, "b", on, "left")], pick)


@query(
    "join_scalar_cte",
    """
    WITH overall AS (SELECT avg(o_totalprice) AS mean FROM orders)
    SELECT o_orderpriority, CAST(count_if(o_totalprice > mean) AS BIGINT) AS above,
        CAST(count(*) AS BIGINT) AS n
    FROM orders CROSS JOIN overall GROUP BY o_orderpriority
    """,
)
def join_scalar_cte(t):
    overall = t.orders.agg(F.avg("o_totalprice").alias("mean"))
    return join_models(
        ("o", t.orders),
        [],
        ["o_orderpriority", fct("above", "count_if(o.o_totalprice > overall.mean)"), fct("n", "count(*)")],
        group_by="dims",
        scalars={"overall": overall},
    )


def _sub_on_sql(how):
    return f"""
    SELECT o.o_orderstatus, c.c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM orders o
    {how} JOIN (SELECT c.*, c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) AS near
        FROM customer c) c ON o.o_custkey = c.c_custkey AND c.near
    GROUP BY o.o_orderstatus, c.c_mktsegment
    """


def _sub_on(t, how):
    near = is_in("c.c_nationkey", t.supplier, "s_nationkey", "s_acctbal > 9000")
    return join_models(
        ("o", t.orders),
        [Join(t.customer, "c", [_on_customer(), near], how)],
        ["o_orderstatus", dim("c_mktsegment", side="c"), fct("n", "count(*)")],
        group_by="dims",
    )


@query("join_subquery_on", _sub_on_sql("INNER"))
def join_subquery_on(t):
    return _sub_on(t, "inner")


@query("join_subquery_on_left", _sub_on_sql("LEFT"))
def join_subquery_on_left(t):
    return _sub_on(t, "left")


@query("join_subquery_on_full", _sub_on_sql("FULL"))
def join_subquery_on_full(t):
    return _sub_on(t, "full")


@query(
    "join_left_deep",
    """
    SELECT r.r_name, n.n_name, CAST(count(*) AS BIGINT) AS n_customers,
        round(sum(c.c_acctbal), 2) AS c_acctbal_sum
    FROM customer c INNER JOIN nation n ON c.c_nationkey = n.n_nationkey
    LEFT JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2
    """,
)
def join_left_deep(t):
    return join_models(
        ("c", t.customer),
        [
            Join(t.nation, "n", [F.expr("c.c_nationkey = n.n_nationkey")]),
            Join(t.region, "r", [F.expr("n.n_regionkey = r.r_regionkey")], "left"),
        ],
        [
            dim("r_name", side="r"),
            dim("n_name", side="n"),
            fct("n_customers", "count(*)"),
            fct("c_acctbal", agg="sum"),
        ],
    )


@query(
    "join_agg_dates",
    f"""
    SELECT e.event_type, c.c_mktsegment, {moment("date_trunc('day', e.ts)")} AS datetime,
        {day("e.ts")} AS partition_daily, {day("date_trunc('month', e.ts)")} AS partition_monthly,
        round(sum(e.value), 2) AS value_sum, CAST(count(*) AS BIGINT) AS source_row_count
    FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey
    WHERE CAST(e.ts AS DATE) BETWEEN '2024-01-05' AND '2024-01-11' GROUP BY ALL
    """,
)
def join_agg_dates(t):
    return join_models(
        ("e", staged_events(t)),
        [Join(t.customer, "c", [F.expr("e.user_id = c.c_custkey")], "left")],
        ["event_type", dim("c_mktsegment", side="c"), grain("day", side="e"), fct("value", agg="sum")],
        dates=WEEK,
    )


@query(
    "unnest_array",
    """
    SELECT label, round(sum(x), 4) AS x_sum, round(max(x), 4) AS x_max, CAST(count(*) AS BIGINT) AS x_count
    FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label
    """,
    digits=4,
)
def unnest_array(t):
    rows = unnest_model(t.embeddings, "embedding", ["x"], ["label", fct("x", "cast(x as double)")])
    return select_model(rows, ["label", fct("x", aggs=["sum", "count", "max"])])


@query(
    "unnest_struct",
    """
    SELECT doc_id, source, CAST(count(*) AS BIGINT) AS lines, CAST(max(length(line)) AS BIGINT) AS longest,
        CAST(max(CASE WHEN length(line) > 0 THEN place END) AS BIGINT) AS last_filled
    FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
            generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents)
    GROUP BY doc_id, source
    """,
)
def unnest_struct(t):
    numbered = "transform(split(text, '\\n'), (line, place) -> named_struct('line', line, 'place', place))"
    return unnest_model(
        t.documents,
        numbered,
        ["line", "place"],
        [
            "doc_id",
            "source",
            fct("lines", "count(*)"),
            fct("longest", "cast(max(length(line)) as bigint)"),
            fct("last_filled", "cast(max(case when length(line) > 0 then place end) as bigint)"),
        ],
        group_by="dims",
    )


@query(
    "unnest_json_map",
    """
    SELECT event_type, 'k' AS name, CAST(count(*) AS BIGINT) AS n,
        CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS number_sum
    FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY event_type
    """,
)
def unnest_json_map(t):
    return unnest_model(
        t.events,
        "props",
        ["name", "number"],
        ["event_type", "name", fct("number", agg="sum"), fct("n", "count(*)")],
        json_schema="map<string,bigint>",
    )


@query(
    "unnest_json_array",
    """
    SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, CAST(sum(qty) AS BIGINT) AS qty_sum
    FROM (SELECT o_orderpriority, unnest([o_custkey, o_orderkey]) AS qty FROM orders
          WHERE o_orderstatus <> 'P') GROUP BY o_orderpriority
    """,
)
def unnest_json_array(t):
    # Orders in state P hold an empty list and give no rows.
    items = """CASE WHEN o_orderstatus = 'P' THEN '[]' ELSE
        to_json(array(named_struct('qty', o_custkey), named_struct('qty', o_orderkey))) END"""
    texts = t.orders.withColumn("items", F.expr(items))
    return unnest_model(
        texts,
        "items",
        ["item"],
        ["o_orderpriority", fct("qty_sum", "sum(item.qty)"), fct("n", "count(*)")],
        json_schema="array<struct<qty:bigint>>",
        group_by="dims",
    )


@query(
    "join_all_columns",
    """SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 2) AS s_acctbal, n_nationkey, n_name, n_regionkey
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def join_all_columns(t):
    on = [F.expr("s.s_nationkey = n.n_nationkey")]
    return join_models(("s", t.supplier), [Join(t.nation, "n", on)], [all_from("s"), all_from("n")])
