"""Hard negatives for contrastive training, by angular triangle filtering.

Vectors become integer vectors, ``floor(scale * x)``; the score of two is their integer inner product. Each anchor's
positives are its best rows of the same label; the negatives of a positive are the best rows of other labels whose
scores lie within a window of shares of the positive's score.

Every row stores its norm and its angles to some reference directions. For an anchor a and a row x the angle
between them lies between ``|a_r - x_r|`` and ``min(a_r + x_r, 2 pi - a_r - x_r)`` for each reference r, so its cosine lies
in an interval; norms make it an interval of scores, widened by more than rounding can take away. Rows are cut into
blocks by the nearest reference and the angle to it, so a block has narrow angles and a row of bounds of its own.
An anchor is scored against a block only if the block's bounds meet its window, and in the block only against
the rows whose own bounds do:

1. each anchor scores the rows of its own block, which gives the least score that a positive can have;
2. the other blocks are searched for rows that can reach it, and the best of all are the positives;
3. all blocks are searched for rows of other labels whose bounds meet a window of the anchor's positives.

Anchors meet blocks as groups of a bounded size: a stated set of queries against all rows in blocks. A block is a
bounded number of rows; where one angle holds more (copies), it is split by a hash. Scores are exact: double
precision where no sum can leave its integers, Python's integers otherwise. Where angles tell nothing (random
directions in many dimensions have nearly right angles to any reference) all rows are scored.

Rows with a null id, label or vector or a null or non-finite component take no part. Vectors of different
lengths have no score. Of rows with one id, the first by label and vector stays. Zero and empty vectors score 0. A pair
whose score does not fit a long has none. Fewer rows than asked for give fewer results; no anchors or an empty table give no
rows. Columns beside id, label and vector are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamella.llm.common import column, stored


@dataclass(frozen=True)
class Settings:
    scale: int = 256
    positives: int = 5
    negatives: int = 3
    low: int = 50  # a negative's score lies within these hundredths of the positive's
    high: int = 95
    references: int = 8
    sample: int = 2048  # rows at most, the least by a hash, that references are chosen from
    bins: int = 256  # of angles
    block: int = 8192  # rows of a block, about
    group: int = 4096  # anchors of a group, about


#: Beyond what rounding of an angle can come to, near 0 and pi too, where arccos is steep.
SLACK = 1e-6


def _references(rows: DataFrame, s: Settings) -> np.ndarray:
    """Unit vectors far from each other, chosen from a bounded sample of the commonest length."""
    size = rows.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if size is None:
        return np.empty((0, 0))
    some = rows.filter(F.col("size") == size["size"]).orderBy(F.xxhash64("id"), "id").limit(s.sample).select("vector")
    some = np.array([np.frombuffer(r[0], "<f8") for r in some.collect()]).reshape(-1, size["size"])
    lengths = _norms(some)
    some = some[lengths > 0] / lengths[lengths > 0, None]
    if not len(some):
        return np.empty((0, size["size"]))
    chosen = [0]
    near = some @ some[0]
    while len(chosen) < min(s.references, len(some)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, some @ some[chosen[-1]])
    return some[chosen]


def _norms(vectors: np.ndarray) -> np.ndarray:
    """Lengths, also of vectors whose squares leave the range of doubles."""
    if not vectors.size:
        return np.zeros(len(vectors))
    most = np.abs(vectors).max(axis=1, initial=0)
    safe = np.where(most > 0, most, 1)
    return np.sqrt(((vectors / safe[:, None]) ** 2).sum(axis=1)) * most


def _angles(vectors: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles to the references; of another length, none: bounds then say nothing."""
    if not references.size or vectors.shape[1] != references.shape[1]:
        return np.empty((len(vectors), 0))
    lengths = _norms(vectors)
    unit = vectors / np.where(lengths > 0, lengths, 1)[:, None]
    return np.arccos(np.clip(unit @ references.T, -1, 1))


PREPARED = "id long, label string, vector binary, size int, norm double, angles binary, cell int, bin int"


def _prepare(s: Settings, references: np.ndarray):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, rows in batch.groupby("size"):
                vectors = np.frombuffer(b"".join(rows["vector"]), "<f8").reshape(len(rows), size)
                angles = _angles(vectors, references)
                cell = angles.argmin(axis=1) if angles.shape[1] else np.full(len(rows), -1)
                nearest = angles.min(axis=1) if angles.shape[1] else np.zeros(len(rows))
                yield rows.assign(
                    norm=_norms(vectors),
                    angles=[a.tobytes() for a in angles],
                    cell=cell,
                    bin=np.minimum((nearest / np.pi * s.bins).astype(int), s.bins - 1),
                )

    return each


class Rows:
    """Rows of one length, as matrices."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("id", kind="stable")
        n = len(rows)
        self.ids, self.labels, self.norms = (rows[c].to_numpy() for c in ("id", "label", "norm"))
        self.vectors = np.frombuffer(b"".join(rows["vector"]), "<f8").reshape(n, -1 if n and rows["vector"].iloc[0] else 0)
        angles = b"".join(rows["angles"])
        self.angles = np.frombuffer(angles, "<f8").reshape(n, -1) if angles else np.empty((n, 0))
        self.largest = np.abs(self.vectors).max(initial=0)


def bounds(norm: float, angles: np.ndarray, norms: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of a vector with rows whose angles to the references lie between ``least`` and ``most``."""
    nearest = np.maximum(np.maximum(least - angles, angles - most), 0).max(axis=1, initial=0)
    farthest = np.pi - np.maximum(np.maximum(np.pi - most - angles, angles + least - np.pi), 0).max(axis=1, initial=0)
    high = np.minimum(np.cos(np.maximum(nearest - SLACK, 0)) + SLACK, 1 + SLACK)
    low = np.maximum(np.cos(np.minimum(farthest + SLACK, np.pi)) - SLACK, -1 - SLACK)
    # Rows of a block have norms up to the largest, down to zero: the bounds of a negative cosine are those of the largest norm.
    return norm * norms * np.minimum(low, 0) - 1, norm * norms * np.maximum(high, 0) + 1


def row_bounds(norm: float, angles: np.ndarray, rows: Rows, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for single rows, whose norms are known."""
    own = rows.angles[some]
    nearest = np.abs(own - angles).max(axis=1, initial=0)
    farthest = np.pi - np.abs(np.pi - own - angles).max(axis=1, initial=0)
    size = norm * rows.norms[some]
    high = size * (np.cos(np.maximum(nearest - SLACK, 0)) + SLACK) + 1
    low = size * (np.cos(np.minimum(farthest + SLACK, np.pi)) - SLACK) - 1
    return low, high


def scores(anchor: np.ndarray, largest: float, rows: Rows, some: np.ndarray) -> np.ndarray:
    """Exact integer scores with some rows; ``nan`` or Python integers where longs or doubles do not hold them."""
    vectors = rows.vectors[some]
    if largest * rows.largest * max(1, vectors.shape[1]) < 2**53:
        return vectors @ anchor
    whole = [int(x) for x in anchor]
    found = [sum(a * int(x) for a, x in zip(whole, v)) for v in vectors]
    return np.array([x if -(2**63) <= x < 2**63 else None for x in found], dtype=object)


def best(ids: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores, ties by id; ids ascend."""
    if found.dtype != object and len(found) > 4 * n:
        some = np.flatnonzero(found >= np.partition(found, len(found) - n)[len(found) - n])
    else:
        some = np.arange(len(found))
    order = sorted(some.tolist(), key=lambda k: (-found[k], ids[k])) if found.dtype == object else None
    return np.array(order[:n], dtype=np.int64) if order is not None else some[np.argsort(-found[some], kind="stable")][:n]


FOUND = "anchor_id long, block string, other_id long, score long"
MINED = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _same(anchors: Rows, rows: Rows, k: int, some: np.ndarray) -> np.ndarray:
    return some[(rows.labels[some] == anchors.labels[k]) & (rows.ids[some] != anchors.ids[k])]


def _interval(rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bounds of a block: its largest norm, least and largest angles."""
    return np.array([rows.norms.max()]), rows.angles.min(axis=0)[None, :], rows.angles.max(axis=0)[None, :]


def _home(s: Settings):
    """Each anchor's best rows of its own block."""

    def each(near: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(near) and len(own):
            anchors, rows, block = Rows(near), Rows(own), own["block"].iloc[0]
            every = np.arange(len(rows.ids))
            for k in range(len(anchors.ids)):
                some = _same(anchors, rows, k, every)
                out += _positives(anchors, rows, k, some, block, s)
        return _frame(out, FOUND)

    return each


def _positives(anchors: Rows, rows: Rows, k: int, some: np.ndarray, block: str, s: Settings) -> list[tuple]:
    found = scores(anchors.vectors[k], anchors.largest, rows, some)
    if found.dtype == object:
        some, found = some[found != None], found[found != None]  # noqa: E711
    return [
        (int(anchors.ids[k]), block, int(rows.ids[some[i]]), int(found[i])) for i in best(rows.ids[some], found, s.positives)
    ]


def _abroad(s: Settings):
    """Rows of another block that can be among an anchor's positives."""

    def each(near: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        near = near[near["home"] != own["block"].iloc[0]] if len(own) else near[:0]
        if len(near):
            near = near.sort_values("id", kind="stable")
            anchors, rows, block = Rows(near), Rows(own), own["block"].iloc[0]
            least, span = near["least"].to_numpy(), _interval(rows)
            every = np.arange(len(rows.ids))
            for k in range(len(anchors.ids)):
                if not np.isnan(least[k]) and bounds(anchors.norms[k], anchors.angles[k], *span)[1][0] < least[k]:
                    continue
                some = _same(anchors, rows, k, every)
                if not np.isnan(least[k]):
                    some = some[row_bounds(anchors.norms[k], anchors.angles[k], rows, some)[1] >= least[k]]
                found = _positives(anchors, rows, k, some, block, s)
                out += found if np.isnan(least[k]) else [x for x in found if x[3] >= least[k]]
        return _frame(out, FOUND)

    return each


def _negatives(s: Settings):
    """For each anchor and positive, the best rows of a block that lie within the window."""

    def each(near: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(near) and len(own):
            near = near.sort_values("id", kind="stable")
            anchors, rows, span = Rows(near), Rows(own), _interval(Rows(own))
            for k, positives in enumerate(near["positives"]):
                windows = [(p["id"], p["score"], -(-s.low * p["score"] // 100), s.high * p["score"] // 100) for p in positives]
                # A pair satisfies low * positive <= 100 * negative <= high * positive.
                windows = [w for w in windows if w[2] <= w[3]]
                if not windows:
                    continue
                floor, roof = min(w[2] for w in windows), max(w[3] for w in windows)
                low, high = bounds(anchors.norms[k], anchors.angles[k], *span)
                if high[0] < floor or low[0] > roof:
                    continue
                some = np.flatnonzero(rows.labels != anchors.labels[k])
                low, high = row_bounds(anchors.norms[k], anchors.angles[k], rows, some)
                some = some[(high >= floor) & (low <= roof)]
                found = scores(anchors.vectors[k], anchors.largest, rows, some)
                if found.dtype == object:
                    some, found = some[found != None], found[found != None]  # noqa: E711
                inside = (found >= floor) & (found <= roof)
                some, found = some[inside], found[inside]
                for positive, score, least, most in windows:
                    fits = np.flatnonzero((found >= least) & (found <= most))
                    for i in fits[best(rows.ids[some[fits]], found[fits], s.negatives)]:
                        out.append((int(anchors.ids[k]), positive, score, int(rows.ids[some[i]]), int(found[i])))
        return _frame(out, MINED)

    return each


def _vector(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def _bytes(vectors: pd.Series) -> pd.Series:
    return pd.Series([np.asarray(v, dtype="<f8").tobytes() for v in vectors], dtype="object")


def _blocked(rows: DataFrame, s: Settings) -> DataFrame:
    """``rows`` with their block: consecutive bins of a cell, as many as hold about a block's rows."""
    bins = rows.groupBy("size", "cell", "bin").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("size", "cell").orderBy("bin")  # at most one row for each bin
    bins = bins.withColumn("slice", F.floor((F.sum("n").over(so_far) - 1) / s.block))
    bins = bins.select("size", "cell", "bin", "slice", F.ceil(F.col("n") / s.block).alias("pieces"))
    piece = F.when(F.col("pieces") > 1, F.concat(F.col("bin"), F.lit("."), F.pmod(F.xxhash64("id"), F.col("pieces"))))
    block = F.concat_ws("/", "size", "cell", "slice", F.coalesce(piece, F.lit("")))
    return rows.join(bins, ["size", "cell", "bin"]).withColumn("block", block).drop("slice", "pieces")


def mined(
    rows: DataFrame,
    anchor: Column,
    id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    settings: Settings = Settings(),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` is a condition on the id, given as an expression of column ``id``.
    """
    s = settings
    items = column(vector)
    whole = items.isNotNull() & F.forall(items, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    taking_part = rows.filter(column(id).isNotNull() & column(label).isNotNull() & whole)
    to_bytes = F.pandas_udf(_bytes, "binary")
    taking_part = taking_part.select(
        column(id).cast("long").alias("id"),
        column(label).cast("string").alias("label"),
        to_bytes(_vector(items, s.scale)).alias("vector"),
        F.size(items).alias("size"),
    )
    first = F.min(F.struct("label", "vector", "size")).alias("row")
    taking_part = stored(taking_part.groupBy("id").agg(first).select("id", "row.*"), "vectors")
    references = _references(taking_part, s)
    prepared = stored(taking_part.mapInPandas(_prepare(s, references), PREPARED), "prepared")
    held = stored(_blocked(prepared, s), "blocked").select("id", "label", "vector", "norm", "angles", "size", "block")
    asked = stored(held.filter(anchor).withColumnRenamed("block", "home"), "anchors")

    home = _together(asked.withColumn("block", F.col("home")), held, ["block"], _home(s), FOUND)
    home = stored(home, "home")
    nth = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id"))
    least = home.withColumn("nth", nth).filter(F.col("nth") == s.positives)
    least = least.select(F.col("anchor_id").alias("id"), F.col("score").alias("least"))
    groups = max(1, -(-asked.count() // s.group))
    asked = asked.join(least, "id", "left")
    # Every group of anchors meets every block of its length: a stated set of queries against all rows, in blocks.
    blocks = held.select("size", "block").distinct()
    group = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group")
    spread = held.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def searched(anchors: DataFrame, f, schema: str) -> DataFrame:
        anchors = anchors.select("*", group).join(blocks, "size")
        return _together(anchors, spread, ["block", "group"], f, schema)

    abroad = searched(asked, _abroad(s), FOUND)
    chosen = home.union(abroad).withColumn("nth", nth).filter(F.col("nth") <= s.positives)
    chosen = chosen.groupBy(F.col("anchor_id").alias("id")).agg(
        F.collect_list(F.struct(F.col("other_id").alias("id"), "score")).alias("positives")  # at most s.positives
    )
    chosen = stored(asked.drop("home", "least").join(chosen, "id"), "positives")
    found = searched(chosen, _negatives(s), MINED)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= s.negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def _together(anchors: DataFrame, rows: DataFrame, keys: list[str], f, schema: str) -> DataFrame:
    """Anchors and rows that share their keys, worked on by ``f``."""
    rows = rows.toDF(*rows.columns)  # columns of its own, where both come from the same rows
    return anchors.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(f, schema)
