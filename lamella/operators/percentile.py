"""Exact percentiles of groups of any size and number, by radix selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.roles import ident

#: Bits that a round decides, and the shifts of the four rounds that decide 64.
RADIX = 16
SHIFTS = (48, 32, 16, 0)

#: The layout of a double (IEEE 754).
FRACTION, BIAS, LEAST_NORMAL, LEAST = 2**52, 1023, 2.0**-1022, 2.0**-1074


def ordered_bits(value: Column) -> Column:
    """The bits of a double as a long of the same order; both zeros are 0, nan is above infinity.

    Built from arithmetic that is exact for doubles: powers of two, and quotients by them. The logarithm may be off by one
    next to a power of two, which is put right by comparing.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(size)).cast("int")
    power = F.pow(F.lit(2.0), guess.cast("double"))
    over, under = F.pow(F.lit(2.0), (guess + 1).cast("double")) <= size, power > size
    exponent = F.when(over, guess + 1).when(under, guess - 1).otherwise(guess)
    fraction = size / F.pow(F.lit(2.0), exponent.cast("double")) - 1
    normal = (exponent + BIAS).cast("long") * FRACTION + (fraction * float(FRACTION)).cast("long")
    endless = F.lit(2047 * FRACTION).cast("long")
    bits = (
        F.when(F.isnan(value), endless + 1)
        .when(size == float("inf"), endless)
        .when(size < LEAST_NORMAL, (size / LEAST).cast("long"))
        .otherwise(normal)
    )
    return F.when(value < 0, -bits).otherwise(bits)


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: Column, quantiles: Mapping[str, float]) -> DataFrame:
    """Interpolated percentiles of ``value`` per group, one output column per quantile.

    Spark's own exact percentile holds a group's values in one task. Here equal values are counted, and a wanted
    rank is found from the left of the value's bits: the counts of the 65,536 prefixes of a group say which prefix holds
    the rank, only values with that prefix are counted on, by the next 16 bits, until all 64 are known. No group, hot or
    not, is sorted or held anywhere: a round keeps at most 65,536 counts for each prefix it looks into, after
    combining in every task. Nothing runs now.
    """
    keys = list(keys)
    counted = (
        df.select(*[F.col(ident(k)) for k in keys], value.cast("double").alias("v"))
        .where(F.col("v").isNotNull())
        .groupBy(*[F.col(ident(k)) for k in keys], "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    values = counted.withColumn("bits", ordered_bits(F.col("v")))
    names = [F.col(ident(k)) for k in keys]
    wanted = None
    for shift in SHIFTS:
        held = values if wanted is None else _with(values, wanted, keys, shift + RADIX)
        rest = [] if wanted is None else [F.any_value("ranks").alias("ranks")]
        counts = held.groupBy(*names, F.shiftright("bits", shift).alias("prefix")).agg(
            F.sum("n").alias("n"), F.min("v").alias("v"), *rest
        )
        # At most 65,536 rows, whatever the size of the group.
        within = Window.partitionBy(*names, F.lit(0) if wanted is None else F.shiftright("prefix", RADIX))
        upto = F.sum("n").over(within.orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        placed = {"upto": upto} | ({"total": F.sum("n").over(within)} if wanted is None else {})
        placed = counts.withColumns(placed).withColumn("before", F.col("upto") - F.col("n"))
        ranks = _ranks(quantiles) if wanted is None else F.col("ranks")
        hit = F.filter(ranks, lambda r: (r["rank"] >= F.col("before")) & (r["rank"] < F.col("upto")))
        # Ranks count from the first value of the prefix from here on.
        hit = F.transform(hit, lambda r: r.withField("rank", r["rank"] - F.col("before")))
        wanted = placed.select(*names, "prefix", "v", hit.alias("ranks")).where(F.size("ranks") > 0)
    found = wanted.select(*names, "v", F.inline("ranks"))
    columns = []
    for name in quantiles:
        at = {side: F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("v"))) for side in ("low", "high")}
        part = F.max(F.when(F.col("name") == name, F.col("part")))
        between = at["low"] + (at["high"] - at["low"]) * part
        columns.append(F.when(at["low"] == at["high"], at["low"]).otherwise(between).alias(name))
    return found.groupBy(*names).agg(*columns)


def _ranks(quantiles: Mapping[str, float]) -> Column:
    """The two neighbouring ranks of each percentile, which may have different prefixes, and the position between them."""
    found = []
    for name, q in quantiles.items():
        rank = (F.col("total") - 1) * F.lit(float(q))
        for side, at in (("low", F.floor(rank)), ("high", F.ceil(rank))):
            part = (rank - F.floor(rank)).alias("part")
            found.append(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), at.cast("long").alias("rank"), part))
    return F.array(*found)


def _with(values: DataFrame, wanted: DataFrame, keys: Sequence[str], shift: int) -> DataFrame:
    """The values whose prefix holds a wanted rank, with those ranks."""
    prefix = F.shiftright(F.col(ident("l", "bits")), shift)
    same = [F.col(ident("l", k)).eqNullSafe(F.col(ident("r", k))) for k in keys]
    # Null-safe, so that nothing is derived about the values and all rounds read the same counts.
    same.append(prefix.eqNullSafe(F.col(ident("r", "prefix"))))
    joined = values.alias("l").join(wanted.alias("r"), reduce(lambda a, b: a & b, same))
    return joined.select(*[F.col(ident("l", c)) for c in values.columns], F.col(ident("r", "ranks")))
