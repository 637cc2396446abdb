"""What the operators of this subpackage share: reading, working copies, row identity, components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable
from contextlib import suppress

import pyarrow
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.session import remove, tune, working_path

#: The white space that separates words, as a character class.
WORD = r"[^\x20\x09-\x0D]+"

#: Arrow batches are kept small, since one text may be very long.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


#: glibc's names for its settings (malloc.h).
M_TRIM_THRESHOLD, M_MMAP_THRESHOLD, M_ARENA_MAX = -1, -3, -8


def give_memory_back() -> None:
    """Let this process return what a batch has used, instead of keeping it for the next one.

    Python workers outlive their tasks. Large pieces are mapped and unmapped one by one, and Arrow uses the same allocator.
    Elsewhere than with glibc nothing changes.
    """
    pyarrow.set_memory_pool(pyarrow.system_memory_pool())
    with suppress(OSError, AttributeError):
        settings = ctypes.CDLL(None).mallopt
        for name, value in ((M_MMAP_THRESHOLD, 1 << 18), (M_TRIM_THRESHOLD, 1 << 22), (M_ARENA_MAX, 2)):
            settings(name, value)


# Workers import this module with the first function that they run.
give_memory_back()


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings of these operators."""
    tune(spark)
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark so that any store it knows will do."""
    return prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The copy cuts lineage and survives the loss of executors. Expensive Python work and
    anything read more than once goes through here.
    """
    spark = df.sparkSession
    path = working_path(spark, label)
    df.write.parquet(path)
    copy = spark.read.schema(df.schema).parquet(path)
    copy.stored_at = path
    return copy


def forget(*copies: DataFrame) -> None:
    """Delete stored copies that nothing will read again: what was computed from them is stored itself."""
    for copy in copies:
        path = getattr(copy, "stored_at", None)
        if path is not None:
            remove(copy.sparkSession, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def column(name: str):
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fold_ascii(c):
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def learning_rows(doc_id, folds: int, held: int):
    """True where crc32 of the id as text does not leave ``held``; a null id never teaches."""
    left = F.crc32(doc_id.cast("string").cast("binary")) % folds
    return F.coalesce(left != held, F.lit(False))


def held_out(doc_id, folds: int, held: int):
    """True where crc32 of the id as text leaves ``held``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == held, F.lit(False))


def one_row_each(df: DataFrame, keys: Iterable[str], repeats: str) -> DataFrame:
    """Rows of ``df`` with one left of those alike in ``keys``.

    ``repeats`` says how many there are. Only rows that do repeat are grouped; the grouping keeps
    one row for each key and task before it shuffles, so a key with very many rows does no harm. The row that stays is
    the first by its other columns as JSON, whatever the order of rows.
    """
    keys = list(keys)
    others = F.to_json(F.struct(*[column(c) for c in df.columns if c not in keys]))
    single = df.filter(column(repeats) == 1)
    many = (
        df.filter(column(repeats) > 1)
        .groupBy(*[column(k) for k in keys])
        .agg(F.min_by(F.struct(*[column(c) for c in df.columns]), others).alias("row"))
    )
    return single.unionByName(many.select(*[F.col("row").getField(c).alias(c) for c in df.columns]))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b`` (longs); the root is the smallest node.

    Alternating large and small stars: links are rewritten until every node points at its root,
    which takes a number of rounds that grows with the logarithm of the longest chain. A node with
    very many links never meets its neighbours in one task: its smallest neighbour comes from a
    combining aggregate, and the join that hands it on is one whose hot keys Spark splits.
    """

    def pairs(df, a, b):
        return df.select(a.alias("a"), b.alias("b")).filter("a <> b").distinct()

    a, b, low = F.col("a"), F.col("b"), F.col("low")
    links = stored(pairs(edges, F.greatest("a", "b"), F.least("a", "b")), "links")
    seen = None
    while True:
        both = links.select(a.alias("u"), b.alias("v")).union(links.select(b.alias("u"), a.alias("v")))
        lowest = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low")), "lowest")
        large = both.join(lowest, "u").filter("v > u")
        wide = stored(pairs(large, F.col("v"), low), "large-star")
        forget(links, lowest)
        lowest = stored(wide.groupBy("a").agg(F.min("b").alias("low")), "lowest")
        small = wide.join(lowest, "a").select(b.alias("a"), low.alias("b"))
        small = small.union(lowest.select("a", low.alias("b")))
        links = stored(pairs(small, a, b), "small-star")
        forget(wide, lowest)
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = links.select(b.alias("node")).distinct()
    return links.select(a.alias("node"), b.alias("root")).union(roots.select("node", F.col("node").alias("root")))
