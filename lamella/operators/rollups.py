"""Measures that roll up without losing what they promise: quantiles of any tail, exact distinct counts.

Both need two groupings instead of an aggregate function, so they are operators of their own beside the select lists.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.operators.roles import ident

#: Relative error of a quantile read from buckets.
ACCURACY = 0.01
#: Buckets of positive values are numbered from here, so that numbers are in the order of the values.
MIDDLE, ENDLESS, UNKNOWN = 100_000, 200_000, 300_000


def _base(accuracy: float) -> float:
    if not 0.0075 <= accuracy < 1:
        raise ValueError("the accuracy must lie between 0.0075 and 1")
    return math.log((1 + accuracy) / (1 - accuracy))


def bucket(value: Column, accuracy: float = ACCURACY) -> Column:
    """The number of the logarithmic bucket of a value: all its values are within ``accuracy`` of its middle.

    Negative values have buckets of their own, so do zero, infinities and nan (which counts as largest).
    """
    size = F.abs(value)
    number = F.ceil(F.ln(size) / _base(accuracy)).cast("int") + MIDDLE
    number = F.when(size == float("inf"), ENDLESS).when(size == 0, 0).otherwise(number)
    return F.when(F.isnan(value), UNKNOWN).when(value < 0, -number).otherwise(number)


def middle(number: Column, accuracy: float = ACCURACY) -> Column:
    """The value that stands for a bucket."""
    base = math.exp(_base(accuracy))
    size = F.pow(F.lit(base), (F.abs(number) - MIDDLE - 1).cast("double")) * (2 * base / (base + 1))
    value = F.when(F.abs(number) == ENDLESS, float("inf")).when(number == 0, 0.0).otherwise(size)
    return F.when(number == UNKNOWN, float("nan")).when(number < 0, -value).otherwise(value)


def quantile_buckets(
    df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column | str], accuracy: float = ACCURACY
) -> DataFrame:
    """Per group and measure a map from buckets to counts, from which any quantile is known within ``accuracy``.

    Two values of a bucket differ by 2 ``accuracy`` at most, so a measure that spans nine powers of ten has about a thousand
    buckets, and no doubles have more than 150,000. Groups are counted by bucket before their maps are made, so a
    group of any size is a bounded number of rows after the first combining.
    """
    every = [
        F.struct(F.lit(n).alias("measure"), bucket((F.expr(c) if isinstance(c, str) else c).cast("double"), accuracy).alias("bucket"))
        for n, c in measures.items()
    ]
    rows = df.select(*[F.col(ident(k)) for k in keys], F.inline(F.array(*every)))
    counted = rows.groupBy(*[F.col(ident(k)) for k in keys], "measure", "bucket").agg(F.count(F.lit(1)).alias("bucket rows"))
    return _mapped(counted, keys, list(measures))


def merge_buckets(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """The maps of larger groups: counts of equal buckets are added."""
    maps = F.create_map(*[c for m in measures for c in (F.lit(m), F.col(ident(m)))])
    rows = df.select(*[F.col(ident(k)) for k in keys], F.explode(maps).alias("measure", "bucket map"))
    rows = rows.select(*[F.col(ident(k)) for k in keys], "measure", F.explode_outer("bucket map").alias("bucket", "rows"))
    summed = rows.groupBy(*[F.col(ident(k)) for k in keys], "measure", "bucket").agg(F.sum("rows").alias("bucket rows"))
    return _mapped(summed, keys, measures)


def _mapped(counted: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    entry = F.struct("bucket", "bucket rows")
    maps = []
    for m in measures:
        own = (F.col("measure") == m) & F.col("bucket").isNotNull()
        maps.append(F.map_from_entries(F.collect_list(F.when(own, entry))).alias(m))
    return counted.groupBy(*[F.col(ident(k)) for k in keys]).agg(*maps)


def bucket_count(buckets: Column) -> Column:
    """How many values a map has counted."""
    return F.aggregate(F.map_values(buckets), F.lit(0).cast("long"), lambda n, x: n + x)


def bucket_quantile(buckets: Column, quantile: float, accuracy: float = ACCURACY) -> Column:
    """The interpolated quantile of the values counted in a map; null of none.

    Every value stands for its bucket, so the result is within ``accuracy`` of the exact one where the two
    neighbouring values have one sign.
    """
    if not 0 <= quantile <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    entries = F.array_sort(F.map_entries(buckets))
    rank = (bucket_count(buckets) - 1) * F.lit(float(quantile))

    def at(rank: Column) -> Column:
        """The bucket of a rank, in one walk over the sorted buckets."""
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("found"))

        def step(state, entry):
            seen = state["seen"] + entry["value"]
            found = F.when(state["found"].isNull() & (seen > rank), entry["key"]).otherwise(state["found"])
            return F.struct(seen.alias("seen"), found.alias("found"))

        return middle(F.aggregate(entries, start, step, lambda s: s["found"]), accuracy)

    low, high = at(F.floor(rank)), at(F.ceil(rank))
    between = low + (high - low) * (rank - F.floor(rank))
    return F.when(bucket_count(buckets) > 0, F.when(low == high, low).otherwise(between))


def bucket_metrics(
    df: DataFrame, dims: Sequence[str], wanted: Mapping[str, tuple[str, float]], accuracy: float = ACCURACY
) -> DataFrame:
    """Quantiles per group of ``dims`` from stored maps; ``wanted`` names them: column and quantile."""
    merged = merge_buckets(df, dims, sorted({c for c, _ in wanted.values()}))
    read = [bucket_quantile(F.col(ident(c)), q, accuracy).alias(n) for n, (c, q) in wanted.items()]
    return merged.select(*[F.col(ident(d)) for d in dims], *read)


#: The columns of stored bitmaps: which 32,768 ids a row stands for, and which of them occur.
BUCKET, BITMAP = "id_bucket", "id_bitmap"
#: A part of a bitmap: 64 ids, of which at least one occurs.
WORD, BITS = "word", "bits"


def distinct_bitmaps(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Which ids occur in each group, as bitmaps of 32,768 ids each: a measure whose distinct counts roll up exactly.

    For whole numbers that lie close together (surrogate keys): a bitmap is a list of those of its words of 64 bits
    that are not empty, so groups with few ids take little room. Null ids are not counted.
    """
    number = F.col(ident(column))
    kind = df.schema[column].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise ValueError(f"bitmaps need whole numbers, not {kind}")
    position = F.bitmap_bit_position(number)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (position % 64).cast("int"))
    word = F.floor(position / 64).cast("int")
    named = [F.col(ident(k)) for k in keys]
    rows = df.where(number.isNotNull()).select(*named, F.bitmap_bucket_number(number).alias(BUCKET), word.alias(WORD), bit.alias(BITS))
    return _bitmaps(_united(rows, keys), keys)


def _united(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Words of the same ids as one; of fixed width, so that every task unites its own first without sorting."""
    return words.groupBy(*[F.col(ident(k)) for k in keys], BUCKET, WORD).agg(F.bit_or(BITS).alias(BITS))


def _words(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The words of the bitmaps of larger groups."""
    return _united(df.select(*[F.col(ident(k)) for k in keys], BUCKET, F.inline(BITMAP)), keys)


def _bitmaps(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    return words.groupBy(*[F.col(ident(k)) for k in keys], BUCKET).agg(F.collect_list(F.struct(WORD, BITS)).alias(BITMAP))


def merge_bitmaps(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The bitmaps of larger groups."""
    return _bitmaps(_words(df, keys), keys)


def bitmap_counts(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Exact numbers of different ids per group."""
    counted = _words(df, keys).groupBy(*[F.col(ident(k)) for k in keys])
    return counted.agg(F.sum(F.bit_count(BITS)).alias(name))
