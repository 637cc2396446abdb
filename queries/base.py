"""Registering queries and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella import EventTime, SourceSpec, Tracking, fct, stage_source, tune

DAY = "yyyy-MM-dd"
MOMENT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

# One week of event dates, the run most queries are for.
WEEK = "2024-01-05~2024-01-11"


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


class Tables:
    """The given tables of one scale."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return _read(self.spark, f"{self.folder}/{name}.parquet")


@lru_cache(maxsize=256)
def _read(spark: SparkSession, path: str) -> DataFrame:
    # The tables do not change, so their schema is looked up once per session.
    return spark.read.parquet(path)


def plain(df: DataFrame, digits: int = 2) -> DataFrame:
    """A result in types every engine prints alike: dates as text, numbers as integers or doubles."""
    columns = []
    for f in df.schema:
        if isinstance(f.dataType, (T.StringType, T.IntegralType, T.BooleanType)):
            columns.append(f"`{f.name}`")
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, DAY)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, MOMENT)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None, digits: int = 2):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plain(fn(Tables(tune(spark), folder)), digits)

        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(run, sql)
        return fn

    return register


def day(expr: str) -> str:
    """SQL text of a date, as printed by ``plain``."""
    return f"strftime({expr}, '%Y-%m-%d')"


def moment(expr: str) -> str:
    """SQL text of a timestamp, as printed by ``plain``."""
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


EVENTS = SourceSpec("events", event_time=EventTime("ts"), tracking=Tracking(lookback_days=3))
ORDERS = SourceSpec("orders", event_time=EventTime("o_orderdate"))


def staged_events(t: Tables, dates=None, **options) -> DataFrame:
    """The events as a staged model: who, what, when, and the value as a fact."""
    return stage_source(
        t.events, EVENTS, ["event_id", "user_id", "event_type", fct("value")], dates=dates, **options
    )


def staged_orders(t: Tables, dates=None, **options) -> DataFrame:
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", fct("o_totalprice")]
    return stage_source(t.orders, ORDERS, names, dates=dates, **options)
