"""Counts over an interval join, from running totals in the order of points and ends instead of from its pairs.

The pairs of an interval join grow with the product of both sides, their number per group need not. Points and both ends
of the intervals are dealt into ranges of their values; within a range, and over the totals of the ranges before it, run

* the numbers of points: how many an interval holds is the number up to its high end less that before its low end,
* the number of intervals open: a point is in none where it is 0,
* the last point: an interval holds none where that lies before its low end, and else it is the largest it holds.

Rows alike in their value and group are one row. Ends are repeated for each group of points (for different values:
points for each group of intervals), so this is for few groups; the work grows with the rows of both sides.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.operators.intervals import Between, _has
from lamella.operators.roles import ident
from lamella.session import working_path

#: Groups of one side for which the other side's rows are repeated; with more the pairs are made.
GROUPS = 64
#: What is sorted at one value: low ends, then points, then high ends.
LOW, POINT, HIGH = 0, 1, 2
WIDE = T.DecimalType(38, 0)


@dataclass(frozen=True)
class Asked:
    """What is wanted of the pairs, as (alias, column): groups, counts of rows with a value (None: of all rows),
    values of which different ones are counted, and whether the largest point is wanted."""

    dims: Sequence[tuple[str, str]]
    counted: Sequence[tuple[str, str] | None]
    distinct: Sequence[tuple[str, str]]
    largest: bool


def count_name(k: int) -> str:
    return f"pair count {k}"


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = working_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _value(expr: str, kind: T.DataType) -> Column:
    return F.expr(expr) + F.lit(0.0).cast(kind) if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else F.expr(expr)


def _group(alias: str, dims: Sequence[str], real: int = 0) -> Column:
    """The dimensions of a side as one value that is never null."""
    return F.struct(F.lit(real).alias("no column"), *[F.col(ident(alias, d)).alias(d) for d in dims])


def _packed(alias: str, df: DataFrame) -> Column:
    """All columns of a side as one, so that none has the name of another column here."""
    return F.struct(*[F.col(ident(alias, c)).alias(c) for c in df.columns]).alias(alias)


def _running(events: DataFrame, group: str, sums: Sequence[str]) -> DataFrame:
    """Running totals per group in the order of values and kinds, and the last point so far.

    ``events`` are stored by ranges; rows of one value may lie in several of them.
    """
    dealt = events.repartitionByRange("value", "kind", "spread").withColumn("range", F.spark_partition_id())
    dealt = _kept(dealt, "interval-ends")
    point = F.when(F.col("kind") == POINT, F.col("value"))
    whole = dealt.groupBy("range", group).agg(*[F.sum(s).alias(s) for s in sums], F.max(point).alias("last"))
    earlier = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = whole.select(
        "range",
        group,
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"{s} before") for s in sums],
        F.max("last").over(earlier).alias("last before"),
    )
    so_far = Window.partitionBy("range", group).orderBy("value", "kind").rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.select("*", *[F.sum(s).over(so_far).alias(f"{s} run") for s in sums], F.max(point).over(so_far).alias("last run"))
    run = run.join(offsets, ["range", group])
    totals = {f"{s} total": F.col(f"{s} run") + F.col(f"{s} before") for s in sums}
    return run.withColumns({**totals, "last": F.coalesce("last run", "last before")})


def pair_counts(base: tuple[str, DataFrame], other: tuple[str, DataFrame], how: str, between: Between, asked: Asked) -> DataFrame | None:
    """Partial counts of an interval join with rows per pair of groups; None where its pairs have to be made.

    The columns are a struct for either side, which holds its dimensions (and the largest point, or a different
    value), and the counts, which add up.
    """
    sides = {base[0]: base[1].alias(base[0]), other[0]: other[1].alias(other[0])}
    p = base[0] if _has(sides[base[0]], between.point) else other[0]
    i = other[0] if p == base[0] else base[0]
    if not (_has(sides[p], between.point) and _has(sides[i], between.low) and _has(sides[i], between.high)):
        return None
    kinds = [sides[a].select(F.expr(e)).schema[0].dataType for a, e in ((p, between.point), (i, between.low), (i, between.high))]
    plain = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
    if not isinstance(kinds[0], plain) or any(k != kinds[0] for k in kinds) or {p, i} & {"value", "low", "high"}:
        return None
    if asked.distinct and (how != "inner" or any(a != p for a, _ in asked.distinct)):
        return None
    dims = {a: list(dict.fromkeys(c for s, c in asked.dims if s == a)) for a in (p, i)}
    held = [*dims[p], *(c for _, c in asked.distinct), *([between.point.split(".")[-1]] if asked.largest else [])]
    if len(set(held)) < len(held):
        return None
    points = sides[p].select(_packed(p, base[1] if p == base[0] else other[1]), _value(between.point, kinds[0]).alias("value"), _group(p, dims[p]).alias("point group"))
    spans = sides[i].select(
        _packed(i, base[1] if i == base[0] else other[1]), _value(between.low, kinds[0]).alias("low"), _value(between.high, kinds[0]).alias("high"), _group(i, dims[i]).alias("span group")
    )
    groups = {}
    for rows, name, wanted in ((points, "point group", True), (spans, "span group", bool(asked.distinct))):
        if wanted:
            groups[name] = _kept(rows.select(name).distinct().limit(GROUPS + 1), "groups")
            if groups[name].count() > GROUPS:
                return None

    counts = [count_name(k) for k in range(len(asked.counted))]

    def grouped(rows: DataFrame, alias: str, *keys: str) -> DataFrame:
        """Rows alike in their keys as one, with the number of all of them and of those with each counted value."""
        there = [
            F.count(F.lit(1) if c is None or c[0] != alias else F.col(ident(*c))).alias(n) for n, c in zip(counts, asked.counted)
        ]
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *there)

    points_of = grouped(points, p, "value", "point group")
    spans_of = grouped(spans, i, "low", "high", "span group")
    whole = F.col("low") <= F.col("high")
    ended = spans_of.where(whole)

    # Points and ends in one table: what points add up to, and what ends carry.
    sums = ["rows", *counts]
    span_kind, value_kind = spans_of.schema["span group"].dataType, kinds[0]
    at = points_of.where("value IS NOT NULL").select(
        "value", F.lit(POINT).alias("kind"), F.lit(0).cast("long").alias("spread"), "point group", *sums, F.lit(0).cast("long").alias("open"),
        F.lit(None).cast(value_kind).alias("low"), F.lit(None).cast(span_kind).alias("span group"),
        *[F.lit(0).cast("long").alias(f"span {s}") for s in sums],
    )
    # One copy for no point at all, so that no end is lost where there are no points.
    none = F.struct(F.lit(1).alias("no column"), *[F.lit(None).cast(points.schema[p].dataType[d].dataType).alias(d) for d in dims[p]])
    one = points.sparkSession.range(1)
    copies = groups["point group"].unionByName(one.select(none.alias("point group")))
    ends = F.inline(F.array(*[
        F.struct(F.col(end).alias("value"), F.lit(kind).alias("kind"), (sign * F.col("rows")).alias("open"))
        for end, kind, sign in (("low", LOW, 1), ("high", HIGH, -1))
    ]))
    carried = ended.select(
        F.xxhash64("low", "high", "span group").alias("spread"), "low", "span group", *[F.col(s).alias(f"span {s}") for s in sums], ends
    )
    carried = carried.crossJoin(F.broadcast(copies)).select("*", *[F.lit(0).cast("long").alias(s) for s in sums])
    run = _running(at.unionByName(carried), "point group", [*sums, "open"])

    keeps = {"inner": (), "left": (base[0],), "right": (other[0],), "full": (base[0], other[0])}[how]
    end, meets = F.col("kind") == HIGH, F.coalesce(F.col("last") >= F.col("low"), F.lit(False))

    def pairs(counted) -> Column:
        """What an end adds to a count, or takes back."""
        ours, theirs = "rows total", "span rows"
        if counted is not None and counted[0] == p:
            ours = f"{count_name(asked.counted.index(counted))} total"
        elif counted is not None:
            theirs = f"span {count_name(asked.counted.index(counted))}"
        return F.col(ours).cast("decimal(19,0)") * F.col(theirs).cast("decimal(18,0)")

    def alone(counted, side: str, prefix: str = "") -> Column:
        """What unmatched rows of a side add to a count."""
        if counted is None:
            return F.col(f"{prefix}rows")
        return F.col(prefix + count_name(asked.counted.index(counted))) if counted[0] == side else F.lit(0)

    point = F.col("kind") == POINT

    def added(counted) -> Column:
        pair = pairs(counted)
        return F.sum(F.when(point, alone(counted, p).cast(WIDE)).when(end, pair).otherwise(-pair)).cast(WIDE)

    largest = F.max(F.when(point, F.col("value")).when(end & meets, F.col("last"))).alias("largest")
    met = run.where(~point | (F.col("`open total`") == 0) if p in keeps else ~point)
    met = met.groupBy("point group", "span group").agg(
        added(None).alias("pairs"), *[added(c).alias(n) for n, c in zip(counts, asked.counted)], largest
    )
    parts = [met.where("pairs > 0").drop("pairs")]
    if p in keeps:
        parts.append(points_of.where("value IS NULL").select(
            "point group", F.lit(None).cast(span_kind).alias("span group"),
            *[alone(c, p).cast(WIDE).alias(n) for n, c in zip(counts, asked.counted)], F.col("value").alias("largest"),
        ))
    if i in keeps:
        found = run.where(end).groupBy("low", "value", "span group").agg(
            F.max(meets).alias("met"), *[F.first(f"span {s}").alias(f"span {s}") for s in sums]
        )
        lone = found.where("NOT met").drop("met", "low", "value")
        never = spans_of.where(~F.coalesce(whole, F.lit(False))).select("span group", *[F.col(s).alias(f"span {s}") for s in sums])
        parts.append(lone.unionByName(never).select(
            F.lit(None).cast(points_of.schema["point group"].dataType).alias("point group"), "span group",
            *[alone(c, i, "span ").cast(WIDE).alias(n) for n, c in zip(counts, asked.counted)], F.lit(None).cast(value_kind).alias("largest"),
        ))
    different = [c for _, c in asked.distinct]
    blank = {c: F.lit(None).cast(points.schema[p].dataType[c].dataType) for c in different}
    parts = [part.select("*", *[v.alias(f"value of {c}") for c, v in blank.items()]) for part in parts]
    for c in different:
        covered = _covered(points, ended, p, c, groups["span group"])
        more = [F.col(f"value of {c}") if d == c else blank[d].alias(f"value of {d}") for d in different]
        parts.append(covered.select(
            "point group", "span group", *[F.lit(0).cast(WIDE).alias(n) for n in counts], F.lit(None).cast(value_kind).alias("largest"), *more
        ))
    result = parts[0]
    for more in parts[1:]:
        result = result.unionByName(more)

    def side(name: str, columns: Sequence[str], more: Sequence[Column] = ()) -> Column:
        return F.struct(F.lit(0).alias("no column"), *[F.col(ident(name, c)).alias(c) for c in columns], *more)

    own = [F.col("largest").alias(between.point.split(".")[-1])] if asked.largest else []
    own += [F.col(f"`value of {c}`").alias(c) for c in different]
    return result.select(side("point group", dims[p], own).alias(p), side("span group", dims[i]).alias(i), *[F.col(ident(n)) for n in counts])


def _covered(points: DataFrame, ended: DataFrame, alias: str, column: str, groups: DataFrame) -> DataFrame:
    """The different values of a column among the points that lie in any interval of a group."""
    name = f"value of {column}"
    rows = points.select("value", "point group", F.col(ident(alias, column)).alias(name))
    rows = rows.where(F.col("value").isNotNull() & F.col(ident(name)).isNotNull()).distinct().crossJoin(F.broadcast(groups))
    at = rows.select("*", F.lit(POINT).alias("kind"), F.xxhash64(F.col(ident(name))).alias("spread"), F.lit(0).cast("long").alias("open"))
    ends = F.inline(F.array(*[
        F.struct(F.col(end).alias("value"), F.lit(kind).alias("kind"), F.lit(sign).cast("long").alias("open"))
        for end, kind, sign in (("low", LOW, 1), ("high", HIGH, -1))
    ]))
    carried = ended.select("span group", F.xxhash64("low", "high").alias("spread"), ends)
    run = _running(at.unionByName(carried, allowMissingColumns=True), "span group", ["open"])
    inside = run.where((F.col("kind") == POINT) & (F.col("`open total`") > 0))
    return inside.select("point group", "span group", F.col(ident(name))).distinct()
