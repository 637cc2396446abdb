"""Pages deep inside a sorted result."""

from __future__ import annotations

import bisect
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.operators.grouping import sort_keys
from lamella.operators.roles import ident
from lamella.session import working_path

#: The number of a row's range, and what orders rows that the sort keys leave equal.
RANGE, TIE = "page range", "page tie"
#: The number of a row within its range.
NUMBER = "page number"


class Pages:
    """A result in an order, of which any page can be read without the rows before it.

    A limit with an offset sends all rows before the page through one task. Here rows are dealt once, into ranges of the
    sort keys in a copy in the shared folder; counts per range (a list of bounded length) say which ranges hold a page,
    and only those are read and sorted. No task holds more than a range, however long the page is. The copy serves all
    pages of the same order.

    Rows with equal keys are ordered by a hash of the row, so pages do not overlap and a value that very many
    rows have does not make one range of them. Offset and limit may exceed the rows there are.
    """

    def __init__(self, df: DataFrame, order_by, ranges: int = 200):
        if ranges < 1:
            raise ValueError("at least one range is needed")
        self.columns, self.order_by = df.columns, order_by
        spark = df.sparkSession
        kept = df.withColumn(TIE, F.xxhash64(*[_hashable(df, c) for c in df.columns]))
        # Rows alike in all columns may lie in any order, so their number spreads them.
        spread = F.pmod(F.monotonically_increasing_id(), F.lit(1024))
        dealt = kept.repartitionByRange(ranges, *sort_keys(order_by), F.col(ident(TIE)), spread)
        path = working_path(spark, "pages")
        dealt.withColumn(RANGE, F.spark_partition_id()).write.partitionBy(RANGE).parquet(path)
        schema = T.StructType([*dealt.schema, T.StructField(RANGE, T.IntegerType())])
        self.stored = spark.read.schema(schema).parquet(path)
        counts = self.stored.groupBy(RANGE).count().orderBy(RANGE).collect()
        self.ranges = [r[0] for r in counts]
        self.ends = list(accumulate(r[1] for r in counts))

    @property
    def rows(self) -> int:
        return self.ends[-1] if self.ends else 0

    def holding(self, offset: int, limit: int) -> tuple[list[int], int]:
        """The ranges that hold the page, and the rows of the first one that lie before it."""
        last = min(offset + limit, self.rows)
        if limit < 1 or offset >= last:
            return [], 0
        first = bisect.bisect_right(self.ends, offset)
        end = bisect.bisect_left(self.ends, last)
        return self.ranges[first : end + 1], offset - (self.ends[first - 1] if first else 0)

    def page(self, offset: int, limit: int) -> DataFrame:
        """``limit`` rows after the first ``offset``, in order."""
        if offset < 0 or limit < 0:
            raise ValueError("offset and limit must not be negative")
        chosen, skipped = self.holding(offset, limit)
        columns = [ident(c) for c in self.columns]
        if not chosen:
            return self.stored.where("false").select(*columns)
        keys, at = [*sort_keys(self.order_by), F.col(ident(TIE))], F.col(ident(RANGE))
        # Ranges within the page are taken whole. Only the first and the last are cut, by numbers in their order.
        last = self.ranges.index(chosen[-1])
        left = min(offset + limit, self.rows) - (self.ends[last - 1] if last else 0)
        cut = [chosen[0]] if skipped else []
        cut += [chosen[-1]] if offset + limit < self.ends[last] and chosen[-1] not in cut else []
        whole = [r for r in chosen if r not in cut]
        parts = [self.stored.where(at.isin(whole))] if whole else []
        if cut:
            number = F.row_number().over(Window.partitionBy(at).orderBy(*keys))
            numbered = self.stored.where(at.isin(cut)).withColumn(NUMBER, number)
            own = F.col(ident(NUMBER))
            kept = ((at != chosen[0]) | (own > skipped)) & ((at != chosen[-1]) | (own <= left))
            parts.append(numbered.where(kept).drop(NUMBER))
        held = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return held.orderBy(*keys).select(*columns)


def _hashable(df: DataFrame, name: str):
    """Maps have no hash of their own."""
    column = F.col(ident(name))
    return F.to_json(F.struct(column)) if "map<" in df.schema[name].dataType.simpleString() else column


def deep_page(df: DataFrame, order_by, offset: int, limit: int, ranges: int = 200) -> DataFrame:
    """One page of a sorted result; keep a ``Pages`` for several."""
    return Pages(df, order_by, ranges).page(offset, limit)
