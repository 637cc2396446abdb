"""Data checks over the given tables; each returns failing rows."""

from pyspark.sql import functions as F

from lamella import Join, Table, checks_for, describe_table, dim, join_models, read_seed, run_checks, write_incremental
from lamella.operators import checks
from lamella.session import working_path
from queries.base import WEEK, day, moment, query, staged_events


def _holes(t):
    """Events whose value is unknown for one kind, for whole days of it."""
    return t.events.withColumn("value", F.when(F.expr("event_type <> 'error' or day(ts) > 3"), F.col("value")))


_HOLES = """SELECT *, CASE WHEN event_type <> 'error' OR day(ts) > 3 THEN value END AS v FROM events"""


@query("check_not_null", f"SELECT event_id, user_id, event_type FROM ({_HOLES}) WHERE v IS NULL")
def check_not_null(t):
    return checks.not_null(_holes(t), "value").select("event_id", "user_id", "event_type")


@query(
    "check_null_counts",
    f"SELECT 'value' AS column_name, CAST(count(*) AS BIGINT) AS nulls FROM ({_HOLES}) WHERE v IS NULL",
)
def check_null_counts(t):
    return checks.null_counts(_holes(t), ["event_id", "user_id", "value"])


@query(
    "check_unique",
    """SELECT o_custkey, CAST(count(*) AS BIGINT) AS n_rows FROM orders
        GROUP BY o_custkey HAVING count(*) > 1""",
)
def check_unique(t):
    return checks.unique(t.orders, "o_custkey")


@query(
    "check_unique_where",
    """SELECT o_custkey, CAST(count(*) AS BIGINT) AS n_rows FROM orders WHERE o_orderstatus = 'P'
        GROUP BY o_custkey HAVING count(*) > 1""",
)
def check_unique_where(t):
    return checks.unique(t.orders, "o_custkey", "o_orderstatus = 'P'")


@query(
    "check_unique_columns",
    """SELECT l_partkey, l_suppkey, CAST(count(*) AS BIGINT) AS n_rows FROM lineitem
        GROUP BY 1, 2 HAVING count(*) > 1""",
)
def check_unique_columns(t):
    return checks.unique(t.lineitem, ["l_partkey", "l_suppkey"])


@query(
    "check_accepted_values",
    """SELECT event_type, CAST(count(*) AS BIGINT) AS n_rows FROM events
        WHERE event_type NOT IN ('click', 'view') GROUP BY 1""",
)
def check_accepted_values(t):
    return checks.accepted_values(t.events, "event_type", ["click", "view"])


@query(
    "check_relationships",
    """SELECT o_custkey, CAST(count(*) AS BIGINT) AS n_rows FROM orders
        WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1""",
)
def check_relationships(t):
    return checks.relationships(t.orders, "o_custkey", t.customer.where("c_acctbal > 0"), "c_custkey")


def _multiplied(t, how):
    """Events joined to the orders of their user, which repeats or loses rows."""
    on = [F.expr("e.user_id = o.o_custkey")]
    return join_models(
        ("e", staged_events(t)),
        [Join(t.orders, "o", on, how)],
        ["event_id", dim("o_orderkey", side="o")],
    )


def _count_sql(how, join_type, message):
    return f"""
    WITH parent AS (SELECT * FROM events WHERE CAST(ts AS DATE) BETWEEN '2024-01-05' AND '2024-01-11'),
    p AS (SELECT count(*) AS n FROM parent),
    c AS (SELECT count(*) AS n FROM parent e
        {how} JOIN orders o ON e.user_id = o.o_custkey)
    SELECT CAST(p.n AS BIGINT) AS parent_row_count, CAST(c.n AS BIGINT) AS current_row_count,
        CAST(c.n - p.n AS BIGINT) AS row_count_diff, '{join_type}' AS join_type, '{message}' AS test_result
    FROM p, c WHERE c.n > p.n
    """


@query("check_equal_row_count", _count_sql("LEFT", "left", checks.LEFT_JOIN_GREW))
def check_equal_row_count(t):
    return checks.equal_row_count(_multiplied(t, "left"), staged_events(t), WEEK)


@query("check_equal_or_lower_row_count", _count_sql("INNER", "inner", checks.JOIN_GREW))
def check_equal_or_lower_row_count(t):
    return checks.equal_or_lower_row_count(_multiplied(t, "inner"), staged_events(t), WEEK, "inner")


@query(
    "check_no_null_aggregates",
    f"""SELECT {day("ts")} AS partition_daily FROM ({_HOLES}) WHERE event_type = 'error'
        GROUP BY 1 HAVING sum(v) IS NULL""",
)
def check_no_null_aggregates(t):
    errors = _holes(t).where("event_type = 'error'").withColumn("partition_daily", F.to_date("ts"))
    return checks.no_null_aggregates(errors, "value", "2024-01-01~2024-01-30")


@query(
    "freshness",
    f"""
    SELECT {moment("max(ts)")} AS max_loaded_at,
        CAST(datesub('second', max(ts), TIMESTAMP '2024-01-31 12:00:00') AS BIGINT) AS age_seconds,
        CASE WHEN datesub('second', max(ts), TIMESTAMP '2024-01-31 12:00:00') > 86400 THEN 'error'
            WHEN datesub('second', max(ts), TIMESTAMP '2024-01-31 12:00:00') > 21600 THEN 'warn'
            ELSE 'pass' END AS status
    FROM events WHERE event_type = 'purchase'
    """,
)
def freshness(t):
    asof = F.expr("timestamp_ntz'2024-01-31 12:00:00'")
    return checks.freshness(t.events, "ts", asof, (6, "hour"), (1, "day"), "event_type = 'purchase'")


@query(
    "run_checks",
    f"""
    SELECT 'custom' AS "check", CAST(count_if(value > 300) AS BIGINT) AS failing_rows,
        CASE WHEN count_if(value > 300) > 0 THEN 'fail' ELSE 'pass' END AS status FROM events
    UNION ALL SELECT 'ids', 0, 'pass' UNION ALL SELECT 'row_count', NULL, 'skip'
    UNION ALL SELECT 'value', CAST(count(*) AS BIGINT), 'fail' FROM ({_HOLES}) WHERE v IS NULL
    """,
)
def run_all(t):
    return run_checks(
        t.events,
        {
            "custom": lambda df: df.where("value > 300"),
            "ids": lambda df: checks.unique(df, "event_id"),
            "row_count": lambda df: checks.equal_row_count(df, df),
            "value": lambda df: checks.not_null(_holes(t), "value"),
        },
    )


@query(
    "run_checks_in_one_read",
    f"""
    SELECT 'known' AS "check", CAST(count(DISTINCT event_type) FILTER (event_type NOT IN ('click', 'purchase')) AS BIGINT)
        AS failing_rows, CASE WHEN count_if(event_type NOT IN ('click', 'purchase')) > 0 THEN 'fail' ELSE 'pass' END
        AS status FROM events
    UNION ALL SELECT 'large', CAST(count_if(v > 300) AS BIGINT), CASE WHEN count_if(v > 300) > 0 THEN 'fail' ELSE 'pass' END
        FROM ({_HOLES})
    UNION ALL SELECT 'rows', 0, 'pass' UNION ALL SELECT 'users', 0, 'pass'
    UNION ALL SELECT 'value', CAST(count(*) AS BIGINT), 'fail' FROM ({_HOLES}) WHERE v IS NULL
    UNION ALL SELECT 'ids', 0, 'pass' UNION ALL SELECT 'inner', NULL, 'skip'
    """,
)
def run_checks_in_one_read(t):
    """Five checks share a read of the model; only the search for repeated ids groups it once more."""
    model = staged_events(t).drop("value").join(_holes(t).select("event_id", "value"), "event_id")
    return run_checks(
        model,
        {
            "known": checks.only_values("event_type", ["click", "purchase"]),
            "large": checks.rows_where("value > 300"),
            "rows": checks.same_row_count(staged_events(t), WEEK),
            "users": checks.no_nulls("user_id"),
            "value": checks.no_nulls("value"),
            "ids": lambda df: checks.unique(df, "event_id"),
            "inner": checks.same_row_count(staged_events(t), WEEK, join_type="inner"),
        },
    )


@query(
    "write_with_checks",
    """
    SELECT 'cheap' AS "check", CAST(count_if(o_totalprice < 2000) AS BIGINT) AS failing_rows,
        CASE WHEN count_if(o_totalprice < 2000) > 0 THEN 'fail' ELSE 'pass' END AS status FROM orders
    UNION ALL SELECT 'keys', 0, 'pass'
    UNION ALL SELECT 'open', CAST(count_if(o_orderstatus = 'P') AS BIGINT), CASE WHEN count_if(o_orderstatus = 'P') > 0 THEN 'fail'
        ELSE 'pass' END FROM orders
    """,
)
def write_with_checks(t):
    """Checks made while a table is written."""
    path = working_path(t.spark, "checked")
    wanted = {
        "cheap": checks.rows_where("o_totalprice < 2000"),
        "keys": checks.no_nulls("o_orderkey"),
        "open": checks.only_values("o_orderstatus", ["F", "O"]),
    }
    return write_incremental(t.orders, Table(path), refresh=True, checks=wanted)


@query(
    "checks_for_mixed_joins",
    _count_sql("LEFT", "left", checks.LEFT_JOIN_GREW),
)
def checks_for_mixed_joins(t):
    """A model with an inner and a left join gets a row-count check, and one that runs."""
    (chosen,) = checks_for(["inner", "left"])
    check = getattr(checks, chosen.name)
    return check(_multiplied(t, "left"), staged_events(t), WEEK, chosen.join_type)


@query(
    "seed_table",
    """SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation""",
)
def seed_table(t):
    """A table stored as CSV with a header, read back as a seed: all columns are text."""
    path = working_path(t.spark, "seed")
    t.nation.select("n_nationkey", "n_name", "n_regionkey").write.option("header", True).csv(path)
    return read_seed(t.spark, path)


@query(
    "describe_nation",
    """SELECT column_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' ELSE 'string' END AS data_type
        FROM (DESCRIBE nation)""",
)
def describe_nation(t):
    return describe_table(t.nation).select("column_name", "data_type")
