"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only.

Sources in the order of their code points (null last) take the weights in turn and share ``share`` times all words. A
target stops at ``most`` times its source's words; the excess is shared anew by weight until none is above, which is
one level for all sources below their stop, found by running sums over sources ordered by where they stop.

A source is taken in complete epochs as often as its target holds it; what is left is filled by a weighted sample
without replacement: a document's key is ``-ln(u) / quality``, ``u`` a number from a hash of its id, and documents
are taken by rising key until the running sum of their words comes nearest to the budget. No task sorts a
source: the sums of 1024 ranges of keys show in which range the budget ends, that range is cut into 1024 again, and
only the range that is left is sorted.

Quality is the share of the text that is not made of symbols, counted fivefold, from 0.05 to 1.

Null texts have no words and are never taken. Rows with null ids draw by their text. Rows of one id and different texts
are told apart by a hash of the text. Rows alike in id and text are one class with the same key; where the budget ends
inside a class, as many of its rows are taken as fit, and which ones does not matter, since they are alike.
The sources' table has a row for each source and is taken to fit a task. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamella.llm.common import WORD, column, stored

SYMBOLS = r"[#$%&*|<>{}=_~^\\]"
RANGES = 1024
#: What documents are ordered by; rows alike in all of it are one class.
CLASS = ["key", "tie", "print", "size"]


@dataclass(frozen=True)
class Settings:
    weights: tuple = (3.0, 1.0, 2.0)  # of the sources in turn
    share: float = 1.5  # words of the mix, times all words
    most: float = 2.0  # words taken of a source, times its words
    seed: str = "mix"


def quality(text):
    """A weight from 0.05 to 1 that falls with the share of symbols."""
    symbols = F.regexp_count(text, F.lit(SYMBOLS)) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.05), 1 - 5 * symbols), F.lit(0.05))


def sampling_key(doc_id, text, weight, seed: str):
    """``-ln(u) / weight`` with u in (0, 1) from a hash."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.coalesce(text, F.lit(""))))
    digits = F.substring(F.md5(F.concat(name, F.lit(":" + seed)).cast("binary")), 1, 12)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, s: Settings) -> DataFrame:
    """``source, source_size`` to source, source_size, target, epochs, budget (words beyond the epochs)."""
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(s.weights)
    weight = F.get(F.array(*[F.lit(w) for w in s.weights]), turn)
    stop = F.lit(s.most) * F.col("source_size")
    all_rows = Window.partitionBy()
    by_stop = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    level = (F.col("share") - F.col("stopped")) / F.col("weights_left")
    ranked = (
        sizes.withColumn("weight", weight)
        .withColumn("ratio", stop / F.col("weight"))
        .withColumn("share", F.lit(s.share) * F.sum("source_size").over(all_rows))
        .withColumn("rank", F.row_number().over(by_stop))
        .withColumn("stopped", F.sum(stop).over(by_stop) - stop)
        .withColumn("weights_left", F.sum("weight").over(all_rows) - F.sum("weight").over(by_stop) + F.col("weight"))
        .withColumn("level", F.when(level <= F.col("ratio"), level))
        .withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.col("rank"))).over(all_rows))
        .withColumn("target", F.least(stop, F.coalesce(F.col("level") * F.col("weight"), stop)))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    )
    budget = F.col("target") - F.col("epochs") * F.col("source_size")
    return ranked.select("source", "source_size", "target", F.col("epochs").cast("long").alias("epochs"), budget.alias("budget"))


def _same(a: DataFrame, b: DataFrame):
    return a["source"].eqNullSafe(b["source"])


def _where_it_ends(rows: DataFrame, budgets: DataFrame, finer: str) -> DataFrame:
    """For each source the range ``finer`` of keys in which its budget ends, and the budget left for that range."""
    sums = rows.groupBy("source", finer).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy(finer).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    ends = sums.join(budgets, _same(sums, budgets)).filter("before < left AND before + words >= left")
    return ends.select(sums["source"], finer, (F.col("left") - F.col("before")).alias("left"))


def _ends(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source where the partial epoch ends: coarse and fine range, the last class taken, some of its n rows."""
    left = targets.select("source", F.col("budget").alias("left")).filter("left > 0")
    coarse = stored(_where_it_ends(rows, left, "coarse"), "coarse")
    inside = rows.join(coarse.select(F.col("source").alias("s"), F.col("coarse").alias("c")), F.expr("source <=> s AND coarse = c"))
    fine = stored(_where_it_ends(inside, coarse.select("source", "left"), "fine"), "fine")
    last = rows.filter("size > 0").join(
        fine.select(F.col("source").alias("s"), F.col("fine").alias("f"), "left"), F.expr("source <=> s AND fine = f")
    )
    # Rows alike in id and text are one class of n rows, however many they are; the last class may be taken in part.
    classes = last.groupBy("source", *CLASS).agg(F.count("*").alias("n"), F.first("left").alias("left"))
    running = Window.partitionBy("source").orderBy(*CLASS).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("n") * F.col("size")).over(running), F.lit(0))
    fits = F.floor((F.col("left") - before) / F.col("size") + F.lit(0.5))
    classes = classes.withColumn("some", F.least(fits, F.col("n"))).filter("some > 0")
    top = F.struct(F.struct(*CLASS).alias("last"), "some", "n")
    last = classes.groupBy("source").agg(F.max(top).alias("top")).select(F.col("source").alias("s"), "top.*")
    ends = coarse.select("source", "coarse").join(fine.select(F.col("source").alias("t"), "fine"), F.expr("source <=> t"), "left")
    ends = ends.select("source", F.col("coarse").alias("end_coarse"), F.col("fine").alias("end_fine"))
    return ends.join(last, F.expr("source <=> s"), "left").drop("s")


def _measured(df: DataFrame, doc_id: str, source: str, text: str, s: Settings, *more) -> DataFrame:
    """id, source, size, key, what tells its ties apart, and ranges of the key; a key ``k`` lies at k / (1 + k) of them."""
    content = column(text)
    key = sampling_key(column(doc_id), content, quality(content), s.seed)
    at = F.col("key") / (1 + F.col("key"))
    return (
        df.select(
            column(doc_id).alias("id"),
            column(source).alias("source"),
            F.coalesce(F.regexp_count(content, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            key.alias("key"),
            F.coalesce(column(doc_id).cast("string"), F.lit("")).alias("tie"),
            F.xxhash64(content).alias("print"),
            *more,
        )
        .withColumn("coarse", F.floor(at * RANGES))
        .withColumn("fine", F.floor(at * RANGES * RANGES))
    )


def _copies(rows: DataFrame, targets: DataFrame, ends: DataFrame) -> DataFrame:
    """``rows`` with source_size, target and copies: the epochs, and one more before the end of the budget.

    Where the budget ends inside a class of equal rows, the first ones as they lie in a stored copy are taken. A row's
    place is the count of its class in the partitions before its own, and its place there, so no class meets in one task.
    """
    plan = targets.join(ends.withColumnRenamed("source", "s"), F.expr("source <=> s"), "left").drop("s")
    plan = stored(plan.withColumnRenamed("source", "plan_source"), "plan")
    joined = rows.join(plan, F.expr("source <=> plan_source"))
    here = F.struct(*CLASS)
    in_end = F.expr("coarse = end_coarse AND fine = end_fine")
    earlier = F.expr("coarse < end_coarse OR (coarse = end_coarse AND fine < end_fine)") | (in_end & (here < F.col("last")))
    at_end = F.coalesce(in_end & (here == F.col("last")), F.lit(False))
    extra = F.coalesce(earlier, F.lit(False)) | (at_end & (F.col("some") == F.col("n")))
    joined = joined.withColumn("copies", F.col("epochs") + extra.cast("long"))
    if plan.filter("some < n").isEmpty():
        return joined
    in_part = at_end & F.coalesce(F.col("some") < F.col("n"), F.lit(False))
    cut = stored(joined.filter(in_part).withColumn("at", F.monotonically_increasing_id()), "cut")
    cut = cut.withColumn("part", F.shiftright("at", 33))
    in_parts = cut.groupBy("plan_source", "part").agg(F.count("*").alias("rows_here"))
    so_far = Window.partitionBy("plan_source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = in_parts.select(
        F.col("plan_source").alias("s"),
        F.col("part").alias("p"),
        F.coalesce(F.sum("rows_here").over(so_far), F.lit(0)).alias("before"),
    )
    own = F.row_number().over(Window.partitionBy("plan_source", "part").orderBy("at"))
    ranked = cut.withColumn("own", own).join(before, F.expr("plan_source <=> s AND part = p"))
    taken = (F.col("before") + F.col("own") <= F.col("some")).cast("long")
    ranked = ranked.withColumn("copies", F.col("epochs") + taken).select(*joined.columns)
    return joined.filter(~in_part).unionByName(ranked)


def _planned(df: DataFrame, doc_id: str, source: str, text: str, s: Settings):
    rows = stored(_measured(df, doc_id, source, text, s), "measured")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, s), "targets")
    return rows, targets, _ends(rows, targets)


def mixed(df: DataFrame, doc_id="doc_id", source="source", text="text", s: Settings = Settings()) -> DataFrame:
    """One row per row of ``df``: the id, size, source_size, target (its source's), taken (words, repeats counted)."""
    rows, targets, ends = _planned(df, doc_id, source, text, s)
    taken = (F.col("copies") * F.col("size")).cast("long")
    return _copies(rows, targets, ends).select(F.col("id").alias(doc_id), "size", "source_size", "target", taken.alias("taken"))


def mixture(df: DataFrame, doc_id="doc_id", source="source", text="text", s: Settings = Settings()) -> DataFrame:
    """The mix itself: the rows of ``df`` as often as they are taken, with all their columns."""
    _, targets, ends = _planned(df, doc_id, source, text, s)
    whole = F.struct(*[column(c) for c in df.columns]).alias("row")
    taken = _copies(_measured(df, doc_id, source, text, s, whole), targets, ends).filter("copies > 0 AND size > 0")
    repeated = taken.select("row", F.explode(F.expr("sequence(1, copies)")).alias("copy"))
    return repeated.select(*[F.col("row")[c].alias(c) for c in df.columns])
