"""Scalar functions as the models use them."""

from pyspark.sql import functions as F

from lamella import dim, fct, register_macro, select_model
from lamella.functions import scalars as S
from queries.base import day, moment, query


@query(
    "scalar_text",
    """
    SELECT c_custkey, split_part(trim(c_name), '#', 1) AS first_part,
        CAST(len(string_split(c_name, '#')) AS BIGINT) AS parts,
        string_split(c_name, '#')[len(string_split(c_name, '#'))] AS last_part,
        lower(c_mktsegment) AS lowered, upper(c_mktsegment) AS uppered,
        substring(c_name, 1, 8) AS stem, c_mktsegment LIKE 'M%' AS starts_m,
        c_mktsegment IN ('BUILDING', 'FURNITURE') AS solid
    FROM customer
    """,
)
def scalar_text(t):
    parts = S.split_text(F.trim("c_name"), "#")
    return select_model(
        t.customer,
        [
            "c_custkey",
            dim("first_part", S.element(parts, 1)),
            dim("parts", S.cardinality(parts).cast("bigint")),
            dim("last_part", S.element(parts, S.cardinality(parts))),
            dim("lowered", "lower(c_mktsegment)"),
            dim("uppered", "upper(c_mktsegment)"),
            dim("stem", "substring(c_name, 1, 8)"),
            dim("starts_m", "c_mktsegment like 'M%'"),
            dim("solid", "c_mktsegment in ('BUILDING', 'FURNITURE')"),
        ],
    )


@query(
    "scalar_numbers",
    """
    SELECT p_partkey, p_size // 7 AS whole, round(p_retailprice / 7, 4) AS share,
        CAST(round(p_retailprice) AS BIGINT) AS rounded,
        CASE WHEN p_size > 25 THEN NULL ELSE greatest(p_size, 10) END AS strict_top,
        CASE WHEN p_size > 25 THEN NULL ELSE least(p_size, 10) END AS strict_low,
        coalesce(CASE WHEN p_size > 25 THEN p_size END, -1) AS filled,
        round(CAST(CAST(p_retailprice AS DECIMAL(10,2)) / 100.0 AS DOUBLE), 4) AS dollars
    FROM part
    """,
    digits=4,
)
def scalar_numbers(t):
    maybe = F.when(F.col("p_size") <= 25, F.lit(10))
    return select_model(
        t.part,
        [
            "p_partkey",
            dim("whole", S.int_div("p_size", F.lit(7)).cast("int")),
            dim("share", "p_retailprice / 7"),
            dim("rounded", S.to_integer("p_retailprice", "bigint")),
            dim("strict_top", S.greatest("p_size", maybe)),
            dim("strict_low", S.least("p_size", maybe)),
            dim("filled", "coalesce(case when p_size > 25 then p_size end, -1)"),
            dim("dollars", "cast(p_retailprice as decimal(10,2)) / 100.0"),
        ],
    )


@query(
    "scalar_times",
    f"""
    SELECT event_id, {day("ts")} AS on_day, {moment("date_trunc('hour', ts)")} AS on_hour,
        {day("date_trunc('week', ts)")} AS on_week, {day("date_trunc('quarter', ts)")} AS on_quarter,
        {day("CAST(ts AS DATE) + 40")} AS plus_days, {day("CAST(ts AS DATE) + INTERVAL 13 MONTH")} AS plus_months,
        datesub('day', ts, TIMESTAMP '2024-03-01 06:00:00') AS full_days,
        datesub('hour', ts, TIMESTAMP '2024-03-01 06:00:00') AS full_hours,
        isodow(ts) AS weekday, year(ts) AS y, quarter(ts) AS q, month(ts) AS m,
        strftime(ts, '%Y/%m/%d %H-%M-%S') AS printed, isodow(ts) IN (6, 7) AS weekend
    FROM events
    """,
)
def scalar_times(t):
    until = F.expr("timestamp_ntz'2024-03-01 06:00:00'")
    date = F.to_date("ts")
    return select_model(
        t.events,
        [
            "event_id",
            dim("on_day", S.trunc_date("day", "ts")),
            dim("on_hour", S.trunc_to("hour", "ts")),
            dim("on_week", S.trunc_date("week", "ts")),
            dim("on_quarter", S.trunc_date("quarter", "ts")),
            dim("plus_days", S.date_plus("day", 40, date)),
            dim("plus_months", S.date_plus("month", 13, date)),
            dim("full_days", S.date_diff("day", "ts", until)),
            dim("full_hours", S.date_diff("hour", "ts", until)),
            dim("weekday", S.day_of_week("ts").cast("bigint")),
            dim("y", "cast(extract(year from ts) as bigint)"),
            dim("q", "cast(extract(quarter from ts) as bigint)"),
            dim("m", "cast(extract(month from ts) as bigint)"),
            dim("printed", S.format_date("ts", "%Y/%m/%d %H-%i-%s")),
            dim("weekend", S.day_of_week("ts").isin(6, 7)),
        ],
    )


@query(
    "scalar_json",
    """
    SELECT event_id, json_extract_string(props, '$.k') AS k,
        CAST(json_array_length('{"all":[' || event_id || ',2,3]}', '$.all') AS BIGINT) AS items
    FROM events
    """,
)
def scalar_json(t):
    listed = F.concat(F.lit('{"all":['), F.col("event_id").cast("string"), F.lit(",2,3]}"))
    return select_model(
        t.events,
        [
            "event_id",
            dim("k", S.json_scalar("props", "$.k")),
            dim("items", S.json_size(listed, "$.all").cast("bigint")),
        ],
    )


@query(
    "scalar_arrays",
    """
    SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ', ') AS priorities,
        CAST(count(DISTINCT year(o_orderdate)) AS BIGINT) AS years
    FROM orders GROUP BY o_custkey
    """,
)
def scalar_arrays(t):
    # Only values of a small, known range are collected.
    return select_model(
        t.orders,
        [
            "o_custkey",
            fct("priorities", F.array_join(S.distinct_values("o_orderpriority"), ", ")),
            fct("years", F.size(S.distinct_values(F.year("o_orderdate"))).cast("bigint")),
        ],
        group_by="dims",
    )


@query(
    "macro_expression",
    """
    SELECT c_custkey, CASE WHEN c_acctbal >= 5000 THEN 'gold' WHEN c_acctbal >= 0 THEN 'silver' ELSE 'none' END AS tier
    FROM customer
    """,
)
def macro_expression(t):
    register_macro(
        t.spark,
        "customer_tier",
        {"balance": "double"},
        "CASE WHEN balance >= 5000 THEN 'gold' WHEN balance >= 0 THEN 'silver' ELSE 'none' END",
        "string",
    )
    return select_model(t.customer, ["c_custkey", dim("tier", "customer_tier(c_acctbal)")])


@query(
    "scalar_nested_arrays",
    """
    SELECT o_orderkey, array_to_string(list_sort(list_distinct([o_orderstatus, o_orderpriority, o_orderstatus, 'x'])), ',') AS found
    FROM orders
    """,
)
def scalar_nested_arrays(t):
    nested = F.array(F.array("o_orderstatus", "o_orderpriority"), F.array(F.col("o_orderstatus"), F.lit("x")))
    found = F.array_join(F.array_sort(F.array_distinct(F.flatten(nested))), ",")
    return select_model(t.orders, ["o_orderkey", dim("found", found)])
