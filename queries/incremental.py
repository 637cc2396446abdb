"""Incremental writes: each query stores a table, changes it, and reads the result back."""

from pyspark.sql import functions as F

from lamella import compact_partitions, fct, mart, select_model, stage_source, table_for, write_incremental
from lamella.operators.incremental import Table
from lamella.session import working_path
from queries.base import ORDERS, day, query, staged_events

_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


def _orders(t):
    """Orders with their month as partition."""
    staged = stage_source(t.orders, ORDERS, _COLUMNS, row_count=False)
    return staged.drop("datetime", "partition_hourly", "partition_daily")


def _stored(t, df, label):
    table = table_for(df, working_path(t.spark, label))
    write_incremental(df, table, refresh=True)
    return table


_BASE = f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
    {day("date_trunc('month', o_orderdate)")} AS partition_monthly FROM orders"""
_NEW = """SELECT o_orderkey, o_custkey, 'N' AS o_orderstatus, o_totalprice + 1 AS o_totalprice,
    partition_monthly FROM base"""
_SHOW = """SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice,
    partition_monthly"""


def _changed(df):
    return df.withColumn("o_orderstatus", F.lit("N")).withColumn("o_totalprice", F.col("o_totalprice") + 1)


@query(
    "overwrite_partitions",
    f"""
    WITH base AS ({_BASE})
    {_SHOW} FROM base WHERE partition_monthly < '2000-01-01'
    UNION ALL {_SHOW} FROM ({_NEW}) WHERE partition_monthly >= '2000-01-01'
    """,
)
def overwrite_partitions(t):
    orders = _orders(t)
    table = _stored(t, orders, "overwrite")
    late = _changed(orders).where("partition_monthly >= date'2000-01-01'")
    write_incremental(late, table, "overwrite_existing_partitions")
    return table.read(t.spark, orders.schema)


@query(
    "delete_insert_default",
    f"""
    WITH base AS ({_BASE})
    {_SHOW} FROM base WHERE partition_monthly < '1997-01-01' OR partition_monthly >= '1998-01-01'
    UNION ALL {_SHOW} FROM ({_NEW})
        WHERE partition_monthly >= '1997-01-01' AND partition_monthly < '1998-01-01'
    """,
)
def delete_insert_default(t):
    orders = _orders(t)
    table = _stored(t, orders, "delete-insert")
    write_incremental(_changed(orders).where("year(partition_monthly) = 1997"), table)
    return table.read(t.spark, orders.schema)


@query(
    "delete_insert_daily",
    """
    SELECT event_type, strftime(ts, '%Y-%m-%d') AS partition_daily, CAST(count(*) AS BIGINT) AS n FROM events
    WHERE CAST(ts AS DATE) <> DATE '2024-01-10' OR (event_type < 'p' AND hour(ts) < 12) GROUP BY 1, 2
    """,
)
def delete_insert_daily(t):
    # A day is stored by event type; types missing from its new data must go as well.
    events = staged_events(t).drop("partition_hourly", "partition_monthly")
    table = table_for(events, working_path(t.spark, "daily"), ["partition_daily", "event_type"])
    write_incremental(events, table, refresh=True)
    fresh = events.where("partition_daily = date'2024-01-10' and event_type < 'p' and hour(datetime) < 12")
    write_incremental(fresh, table)
    stored = table.read(t.spark, events.schema)
    return stored.groupBy("event_type", "partition_daily").agg(F.count(F.lit(1)).alias("n"))


@query(
    "delete_insert_key",
    f"""
    WITH base AS ({_BASE}), fresh AS (SELECT * FROM ({_NEW}) WHERE o_totalprice > 450000)
    {_SHOW} FROM base WHERE o_custkey NOT IN (SELECT o_custkey FROM fresh)
    UNION ALL {_SHOW} FROM fresh
    """,
)
def delete_insert_key(t):
    orders = _orders(t)
    table = _stored(t, orders, "delete-insert-key")
    write_incremental(
        _changed(orders).where("o_totalprice > 450000"), table, "delete+insert", unique_key="o_custkey"
    )
    return table.read(t.spark, orders.schema)


def _merge_sql(status, price, custkey="base.o_custkey"):
    """Every stored order of state O is matched; those of state F arrive as new ones."""
    return f"""
    WITH base AS ({_BASE}),
    stored AS (SELECT * FROM base WHERE o_orderstatus <> 'F'),
    fresh AS (SELECT * FROM ({_NEW}) JOIN (SELECT o_orderkey AS k FROM base WHERE o_orderstatus <> 'P')
        ON o_orderkey = k)
    SELECT coalesce(s.o_orderkey, f.o_orderkey) AS o_orderkey,
        CASE WHEN f.k IS NULL THEN s.o_custkey WHEN s.o_orderkey IS NULL THEN f.o_custkey
            ELSE s.o_custkey END AS o_custkey,
        CASE WHEN f.k IS NULL THEN s.o_orderstatus WHEN s.o_orderkey IS NULL THEN f.o_orderstatus
            ELSE {status}.o_orderstatus END AS o_orderstatus,
        round(CASE WHEN f.k IS NULL THEN s.o_totalprice WHEN s.o_orderkey IS NULL THEN f.o_totalprice
            ELSE {price}.o_totalprice END, 2) AS o_totalprice,
        coalesce(s.partition_monthly, f.partition_monthly) AS partition_monthly
    FROM stored s FULL JOIN fresh f ON s.o_orderkey = f.o_orderkey
    """


def _merged(t, **columns):
    orders = _orders(t)
    table = _stored(t, orders.where("o_orderstatus <> 'F'"), "merge")
    fresh = _changed(orders.where("o_orderstatus <> 'P'"))
    write_incremental(fresh, table, "merge", unique_key="o_orderkey", **columns)
    return table.read(t.spark, orders.schema)


@query("merge_all", _merge_sql("f", "f"))
def merge_all(t):
    return _merged(t)


@query("merge_update_columns", _merge_sql("f", "s"))
def merge_update_columns(t):
    return _merged(t, update_columns=["o_orderstatus"])


@query("merge_exclude_columns", _merge_sql("s", "f"))
def merge_exclude_columns(t):
    return _merged(t, exclude_columns=["o_orderstatus"])


@query(
    "merge_hot_key",
    f"""
    WITH base AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 1 WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_custkey END AS key
                  FROM ({_BASE})),
    fresh AS (SELECT c_custkey AS key, c_mktsegment AS o_orderstatus, c_acctbal AS o_totalprice FROM customer)
    SELECT o_orderkey, base.key, coalesce(f.o_orderstatus, base.o_orderstatus) AS o_orderstatus,
        round(coalesce(f.o_totalprice, base.o_totalprice), 2) AS o_totalprice FROM base LEFT JOIN fresh f ON base.key = f.key
    UNION ALL SELECT NULL, key, o_orderstatus, round(o_totalprice, 2) FROM fresh
        WHERE key NOT IN (SELECT key FROM base WHERE key IS NOT NULL)
    """,
)
def merge_hot_key(t):
    """Half of all stored rows have one key, some none."""
    key = "CASE WHEN o_orderkey % 2 = 0 THEN 1 WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_custkey END"
    stored = _orders(t).selectExpr("o_orderkey", f"{key} AS key", "o_orderstatus", "o_totalprice")
    table = _stored(t, stored, "merge-hot")
    fresh = t.customer.selectExpr("c_custkey AS key", "c_mktsegment AS o_orderstatus", "c_acctbal AS o_totalprice")
    write_incremental(fresh, table, "merge", unique_key="key")
    return table.read(t.spark, stored.schema)


@query(
    "merge_moves_partition",
    f"""
    SELECT o_orderkey, o_orderstatus,
        CASE WHEN o_orderdate < DATE '1995-03-01' THEN '2002-01-01'
            ELSE {day("date_trunc('month', o_orderdate)")} END AS partition_monthly FROM orders
    """,
)
def merge_moves_partition(t):
    # All rows of two months move to a later one, which leaves those partitions empty.
    orders = _orders(t).select("o_orderkey", "o_orderstatus", "partition_monthly")
    table = _stored(t, orders, "merge-move")
    moved = orders.where("partition_monthly < date'1995-03-01'")
    moved = moved.withColumn("partition_monthly", F.expr("date'2002-01-01'"))
    write_incremental(moved, table, "merge", unique_key="o_orderkey")
    return table.read(t.spark, orders.schema)


@query(
    "append",
    """
    SELECT o_orderstatus, CAST(count(*) + count_if(o_orderstatus = 'O') AS BIGINT) AS n
    FROM orders GROUP BY o_orderstatus
    """,
)
def append(t):
    orders = _orders(t)
    table = _stored(t, orders, "append")
    write_incremental(orders.where("o_orderstatus = 'O'"), table, "append")
    stored = table.read(t.spark, orders.schema)
    return stored.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "full_refresh",
    "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey",
)
def full_refresh(t):
    totals = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    table = Table(working_path(t.spark, "refresh"))
    write_incremental(totals.where("total > 0").withColumn("total", F.lit(0.0)), table, "full_refresh")
    write_incremental(totals, table, "append", refresh=True)
    return table.read(t.spark, totals.schema)


@query(
    "compact_partitions",
    f"""SELECT event_type, {day("ts")} AS partition_daily, CAST(count(*) AS BIGINT) AS n,
        round(sum(value), 2) AS value_sum FROM events GROUP BY 1, 2""",
)
def compact(t):
    events = staged_events(t).drop("partition_hourly")
    table = table_for(events, working_path(t.spark, "compact"))
    for part in ("event_type < 'd'", "event_type >= 'd'"):
        write_incremental(events.where(part), table, "append")
    compact_partitions(t.spark, table, "2024-01-05~2024-01-11")
    stored = table.read(t.spark, events.schema)
    return stored.groupBy("event_type", "partition_daily").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum")
    )


@query(
    "hooks_and_mart",
    """SELECT event_type, CAST(count(*) AS BIGINT) AS source_row_count FROM events GROUP BY event_type""",
)
def hooks_and_mart(t):
    events = staged_events(t).drop("partition_hourly")
    table = table_for(events, working_path(t.spark, "hooks"))
    t.spark.catalog.dropTempView("stored_events")
    write_incremental(
        events,
        table,
        pre_hooks="SET lamella.run = started",
        post_hooks=[
            f"CREATE OR REPLACE TEMPORARY VIEW stored_events AS SELECT * FROM parquet.`{table.path}`"
        ],
    )
    stored = t.spark.table("stored_events")
    return select_model(
        stored.select("event_type", "source_row_count"), ["event_type"], group_by="dims", layer="mart"
    )


@query(
    "merge_fewer_columns",
    f"""
    WITH base AS ({_BASE})
    SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 300000 THEN 'N' ELSE o_orderstatus END AS o_orderstatus,
        round(o_totalprice, 2) AS o_totalprice, partition_monthly FROM base WHERE o_orderstatus <> 'F'
    UNION ALL SELECT o_orderkey, NULL, 'N', NULL, partition_monthly FROM base
        WHERE o_orderstatus = 'F' AND o_totalprice > 300000
    """,
)
def merge_fewer_columns(t):
    # New rows know a key and a status; all else of a stored row stays.
    orders = _orders(t)
    table = _stored(t, orders.where("o_orderstatus <> 'F'"), "merge-fewer")
    fresh = _changed(orders).where("o_totalprice > 300001").select("o_orderkey", "o_orderstatus", "partition_monthly")
    write_incremental(fresh, table, "merge", unique_key="o_orderkey")
    return table.read(t.spark, orders.schema)


@query(
    "delete_insert_fewer_columns",
    f"""
    WITH base AS ({_BASE}), fresh AS (SELECT * FROM base WHERE o_totalprice > 450000)
    {_SHOW} FROM base WHERE o_custkey NOT IN (SELECT o_custkey FROM fresh)
    UNION ALL SELECT o_orderkey, o_custkey, NULL, round(o_totalprice, 2), partition_monthly FROM fresh
    """,
)
def delete_insert_fewer_columns(t):
    orders = _orders(t)
    table = _stored(t, orders, "delete-insert-fewer")
    fresh = orders.where("o_totalprice > 450000").drop("o_orderstatus")
    write_incremental(fresh, table, "delete+insert", unique_key="o_custkey")
    return table.read(t.spark, orders.schema)


@query(
    "delete_insert_null_day",
    """
    SELECT event_type, CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%d') END AS partition_daily,
        CAST(count(*) * CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS BIGINT) AS n
    FROM events WHERE event_type = 'error' OR CAST(ts AS DATE) <> DATE '2024-01-10' OR hour(ts) < 12 GROUP BY 1, 2
    """,
)
def delete_insert_null_day(t):
    # Rows without a day are stored beside the others; new ones join them, and replace nothing.
    events = staged_events(t).drop("partition_hourly", "partition_monthly")
    known = F.when(F.col("event_type") != "error", F.col("partition_daily"))
    events = events.withColumn("partition_daily", known)
    table = table_for(events, working_path(t.spark, "null-day"))
    write_incremental(events, table, refresh=True)
    again = events.where("(partition_daily = date'2024-01-10' and hour(datetime) < 12) or partition_daily is null")
    write_incremental(again, table)
    stored = table.read(t.spark, events.schema)
    return stored.groupBy("event_type", "partition_daily").agg(F.count(F.lit(1)).alias("n"))


@query(
    "refresh_from_itself",
    "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1",
)
def refresh_from_itself(t):
    orders = _orders(t)
    table = _stored(t, orders, "refresh-itself")
    write_incremental(table.read(t.spark, orders.schema).where("o_orderstatus <> 'P'"), table, "full_refresh")
    return table.read(t.spark, orders.schema).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "compact_months",
    f"""SELECT {day("date_trunc('month', o_orderdate)")} AS partition_monthly, CAST(count(*) AS BIGINT) AS n,
        round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""",
)
def compact_months(t):
    orders = _orders(t)
    table = table_for(orders, working_path(t.spark, "compact-months"))
    for part in ("o_orderkey % 2 = 0", "o_orderkey % 2 = 1"):
        write_incremental(orders.where(part), table, "append")
    compact_partitions(t.spark, table, "1996-02-10~1996-04-20")
    stored = table.read(t.spark, orders.schema)
    return stored.groupBy("partition_monthly").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query(
    "publish_mart",
    "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1 HAVING count(*) > 10",
)
def publish_mart(t):
    mart(select_model(t.events, ["event_type", fct("n", "count(*)")]), "events_by_type")
    return t.spark.sql("SELECT event_type, n FROM events_by_type WHERE n > 10")
