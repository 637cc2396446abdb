"""Joins: left-deep, every shorthand compares with the base table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.operators.intervals import Between, interval_join
from lamella.operators.roles import dims, ident
from lamella.session import working_path

JOIN_TYPES = ("inner", "left", "right", "full", "cross")
ON_DIMS = "dims"


@dataclass(frozen=True)
class Join:
    """One joined table.

    ``on`` is a list of column names (equal on base and joined side) and Columns (free conditions,
    which may hold subqueries), or ``"dims"`` for all dimensions both sides share. ``between`` asks for a
    point of one side to lie within an interval of the other, with or without further conditions; no pairs
    are compared that are far apart.

    ``skewed=True`` is for a full join with hot keys, which Spark does not split: both inputs are stored once, and
    rows of hot keys are joined by a left and an anti join, which it does. Keys are those of ``on`` that are names,
    or ``keys``: pairs of SQL expressions that a free condition says are equal.
    """

    df: DataFrame
    alias: str
    on: str | Sequence[str | Column] = ()
    how: str = "inner"
    skewed: bool = False
    between: Between | None = None
    keys: Sequence[tuple[str, str]] = ()

    def __post_init__(self):
        if self.how not in JOIN_TYPES:
            raise ValueError(f"unknown join type {self.how!r}, expected one of {JOIN_TYPES}")
        if self.how == "cross" and (self.on or self.between):
            raise ValueError("a cross join takes no condition")
        if self.how != "cross" and not self.on and not self.between:
            raise ValueError(f"a {self.how} join needs a condition")


def shared_dims(base: DataFrame, other: DataFrame) -> list[str]:
    """Dimensions present on both sides, in base order."""
    theirs = set(dims(other))
    return [c for c in dims(base) if c in theirs]


def condition(base_alias: str, base: DataFrame, join: Join) -> Column:
    if isinstance(join.on, str):
        if join.on != ON_DIMS:
            raise ValueError(f"on must be a list or {ON_DIMS!r}, not {join.on!r}")
        keys: Sequence = shared_dims(base, join.df)
        if not keys:
            raise ValueError(f"{base_alias} and {join.alias} share no dimension")
    else:
        keys = join.on
    parts = [
        F.col(ident(base_alias, k)) == F.col(ident(join.alias, k)) if isinstance(k, str) else k for k in keys
    ]
    return reduce(lambda a, b: a & b, parts)


def join_all(base_alias: str, base: DataFrame, joins: Sequence[Join]) -> DataFrame:
    """Join every table to the base; columns stay addressable as ``alias.column``."""
    sides = {base_alias: base}
    joined = base.alias(base_alias)
    for join in joins:
        if join.alias in sides:
            raise ValueError(f"alias {join.alias!r} is used twice")
        other = join.df.alias(join.alias)
        if join.how == "cross":
            joined = joined.crossJoin(other)
        else:
            on = condition(base_alias, base, join) if join.on else None
            if join.between and join.how == "inner":
                joined = interval_join(joined, other, join.between, on)
            elif join.between:
                joined = _outer_interval_join(sides, joined, join, other, on)
            elif join.how == "full" and join.skewed:
                joined = _full_join(sides, joined, join, other, on, _key_pairs(base_alias, base, join))
            else:
                joined = joined.join(other, on, join.how)
        sides[join.alias] = join.df
    return joined


def add_scalars(joined: DataFrame, scalars: Mapping[str, DataFrame]) -> DataFrame:
    """Make one-row tables available to every row as ``alias.column``.

    Each is a scalar subquery, evaluated once: no join takes place. As with a cross join an empty
    table leaves no rows; a second row is an error.
    """
    for alias, one in scalars.items():
        value = one.select(F.struct("*")).scalar()
        joined = joined.withColumn(alias, value).where(F.col(ident(alias)).isNotNull())
    return joined


def _pack(side: str, df: DataFrame) -> Column:
    return F.struct(*[F.col(ident(side, c)).alias(c) for c in df.columns]).alias(side)


def _stored(df: DataFrame, label: str) -> DataFrame:
    """A copy in the shared folder: what is read several times is computed once, and outlives lost executors."""
    path = working_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _either(sides, join: Join, joined: DataFrame, matched: DataFrame, alone_left, alone_right) -> DataFrame:
    """Matched rows, with those of either side that found nothing; each side is one struct."""
    kinds = {a: joined.schema[a].dataType for a in sides}
    result = matched.select(*sides, join.alias)
    if alone_left is not None:
        result = result.unionByName(alone_left.select(*sides, F.lit(None).cast(matched.schema[join.alias].dataType).alias(join.alias)))
    if alone_right is not None:
        empty = [F.lit(None).cast(kind).alias(a) for a, kind in kinds.items()]
        result = result.unionByName(alone_right.select(*empty, join.alias))
    return result


def _outer_interval_join(sides, joined: DataFrame, join: Join, other: DataFrame, on: Column | None) -> DataFrame:
    """An interval join that keeps rows without a match.

    The rows of a side that keeps them are numbered in a stored copy; those whose number is among no pair are added.
    """
    number = F.monotonically_increasing_id()
    packed = joined.select(*[_pack(a, df) for a, df in sides.items()], number.alias("left row"))
    left = _stored(packed, "left") if join.how in ("left", "full") else packed
    packed = other.select(_pack(join.alias, join.df), number.alias("right row"))
    right = _stored(packed, "right") if join.how in ("right", "full") else packed
    pairs = interval_join(left, right, join.between, on)
    alone_left = alone_right = None
    if join.how in ("left", "full"):
        alone_left = left.join(pairs.select("left row").distinct(), "left row", "left_anti")
    if join.how in ("right", "full"):
        alone_right = right.join(pairs.select("right row").distinct(), "right row", "left_anti")
    return _either(sides, join, left, pairs, alone_left, alone_right)


def _key_pairs(base_alias: str, base: DataFrame, join: Join) -> list[tuple[str, str]]:
    names = shared_dims(base, join.df) if isinstance(join.on, str) else [k for k in join.on if isinstance(k, str)]
    return [*((ident(base_alias, n), ident(join.alias, n)) for n in names), *join.keys]


#: Keys looked at as possibly hot, and the share of a side's rows from which one is.
CANDIDATES, HOT_SHARE = 256, 0.001


def _key_hash(pairs: Sequence[tuple[str, str]], left: DataFrame, right: DataFrame) -> tuple[Column, Column]:
    """A hash of the keys on either side, alike where the keys are equal; null where one of them is."""
    columns: tuple[list, list] = [], []
    for l, r in pairs:
        kinds = [side.select(F.expr(e).alias("key")).schema[0].dataType for side, e in ((left, l), (right, r))]
        empty = left.sparkSession.range(0)
        both = empty.select(F.coalesce(*[F.lit(None).cast(k) for k in kinds]).alias("key")).schema[0].dataType
        for side, e in zip(columns, (l, r)):
            c = F.expr(e).cast(both)
            side.append(c + F.lit(0.0).cast(both) if both.typeName() in ("double", "float") else c)  # -0.0 equals 0.0
    known = [reduce(lambda a, b: a & b, [c.isNotNull() for c in side]) for side in columns]
    return tuple(F.when(k, F.xxhash64(*side)) for k, side in zip(known, columns))


def _hot(side: DataFrame) -> set[int]:
    """Hashes that hold a large share of the rows, from a heavy-hitter sketch: a bounded list."""
    held = side.where("`join hash` IS NOT NULL")
    top = held.agg(F.expr(f"approx_top_k(`join hash`, {CANDIDATES})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return {x["item"] for x in top["top"] or () if x["count"] >= HOT_SHARE * top["n"]}


def _full_join(sides, joined: DataFrame, join: Join, other: DataFrame, on: Column, pairs) -> DataFrame:
    """A full join whose hot keys Spark can split; each input is computed and stored once.

    Rows of hot keys go through a left join plus the other side's unmatched rows, rows with a null key match
    nothing and meet nowhere, all others go through a plain full join. Each side is carried as one struct, so
    ``alias.column`` keeps working. Without known keys all rows go the first way.
    """
    hashes = _key_hash(pairs, joined, other) if pairs else (F.lit(0), F.lit(0))
    left = joined.select(*[_pack(a, df) for a, df in sides.items()], hashes[0].cast("long").alias("join hash"))
    right = other.select(_pack(join.alias, join.df), hashes[1].cast("long").alias("join hash"))
    left, right = _stored(left, "full-left"), _stored(right, "full-right")
    hot = _hot(left) | _hot(right) if pairs else {0}
    is_hot = F.coalesce(F.col("join hash").isin([F.lit(h) for h in sorted(hot)]), F.lit(False)) if hot else F.lit(False)
    known = F.col("join hash").isNotNull()
    some, more = (s.where(is_hot).drop("join hash") for s in (left, right))
    matched = some.join(more, on, "left")
    alone = more.join(some, on, "left_anti")
    if pairs:
        some, more = (s.where(known & ~is_hot).drop("join hash") for s in (left, right))
        plain = some.join(more, on, "full")
        matched = matched.unionByName(plain) if hot else plain
        nulls = [s.where(~known).drop("join hash") for s in (left, right)]
        return _either(sides, join, left, matched, nulls[0], alone.unionByName(nulls[1]) if hot else nulls[1])
    return _either(sides, join, left, matched, None, alone)
