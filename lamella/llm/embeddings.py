"""Exact pairs of embeddings above a cosine, by dual traversal of cover trees.

Unit vectors lie within ``sqrt(2 - 2 * cosine)`` of each other when their cosine reaches the threshold. Equal vectors are
one from then on, with a multiplicity. Vectors are dealt to the nearest of a bounded number of pivots, and large
cells are split, so blocks have a bounded size. Each block gets a cover tree: nested levels whose radii halve, every
node within its parent's radius of the parent's centre, down to single vectors. Pairs of blocks, then pairs of nodes, are
dropped when their centres are farther apart than both covering radii and the threshold allow. A pair of nodes
so close that all their vectors are linked is counted without looking at them. What is left is decided in double
precision. So the links found are exactly those at or above the threshold.

A pair of blocks yields, for each vector with a link, its number of links and one vector it hangs together with:
never the pairs. Components are found from these.

In data without structure (random directions in many dimensions) no block can be dropped, and the number of block
pairs grows with the square of the number of vectors; the cover tree then saves work on near copies only.

Vectors that are null, empty, zero or hold a null or non-finite component link with nothing; vectors of different
lengths never link. Null ids are allowed and are passed over when the smallest id is looked for. Repeated rows are linked
to each other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import column, connected_components, stored


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.9
    block: int = 4096  # vectors of a block, about
    pivots: int = 1024  # at most
    # The children of a block are compared by products of matrices. Wider nodes than this save little of that, and in many
    # dimensions they leave pairs by the million that are too close to drop.
    radii: tuple = (0.5, 0.25, 0.125)

    @property
    def reach(self) -> float:
        """The distance of unit vectors at the threshold."""
        return float(np.sqrt(2 - 2 * self.cosine))


#: What single precision may be wrong by, generously; only used to drop less and count less.
SLACK = 2e-3
#: Pairs of nodes looked at together.
STEP = 1 << 20


def unit(data: pd.Series | list) -> np.ndarray:
    """Rows of double-precision unit vectors from the bytes of doubles."""
    rows = np.frombuffer(b"".join(data), dtype="<f8").reshape(len(data), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _bytes(vectors: pd.Series) -> pd.Series:
    return pd.Series([np.asarray(v, dtype="<f8").tobytes() for v in vectors], dtype="object")


def cover_paths(vectors: np.ndarray, radii: tuple) -> np.ndarray:
    """For each vector, the index of the centre of its node on every level; levels are nested."""
    near = vectors.astype(np.float32)
    dots = near @ near.T
    paths = np.zeros((len(vectors), len(radii)), dtype=np.int32)
    parents = np.zeros(len(vectors), dtype=np.int64)
    for level, radius in enumerate(radii):
        least, own = 1 - radius * radius / 2, np.full(len(vectors), -1, dtype=np.int64)
        # Centres of the level above come first, so that they are centres here as well.
        for i in np.concatenate([np.unique(parents), np.arange(len(vectors))]):
            if own[i] < 0:
                found = (dots[i] >= least) & (own < 0) & (parents == parents[i])
                own[found] = i
                own[i] = i
        paths[:, level] = own
        parents = own
    return paths


class Tree:
    """A cover tree over vectors sorted so that every node holds a range of them.

    Per level: start, end (vectors), centre, radius, and children (a range of the next level's nodes). The first
    level is the root, the last one holds single vectors.
    """

    def __init__(self, vectors: np.ndarray, paths: np.ndarray):
        n = len(vectors)
        self.vectors, self.single = vectors, vectors.astype(np.float32)
        starts = [np.zeros(1, dtype=np.int64)]
        for level in range(paths.shape[1]):
            change = (paths[1:, : level + 1] != paths[:-1, : level + 1]).any(axis=1)
            starts.append(np.concatenate([[0], np.flatnonzero(change) + 1]))
        starts.append(np.arange(n))
        self.levels = []
        for k, start in enumerate(starts):
            end = np.append(start[1:], n)
            # Any member will do as centre; radii are measured from it.
            centre = start
            if k == 0:
                centre = np.array([n // 2])
            of = np.repeat(np.arange(len(start)), end - start)
            apart = _distance((self.single * self.single[centre][of]).sum(axis=1))
            radius = np.maximum.reduceat(apart, start)
            if k == len(starts) - 1:
                radius = np.zeros(n)
            child = np.searchsorted(starts[k + 1], np.append(start, n)) if k + 1 < len(starts) else None
            self.levels.append((start, end, centre, radius, child))


def _distance(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * dots, 0))


class Union:
    """Disjoint sets over 0..n-1; the smallest member is the root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if (up == x).all():
                return x
            x = self.parent[up]

    def unite(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            a, b = self.find(x), self.find(y)
            apart = a != b
            if not apart.any():
                return
            x, y = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


class Traversal:
    """Both trees from the root down; ``same`` when it is one tree, whose pairs are then seen once."""

    def __init__(self, a: Tree, b: Tree, rows_a: np.ndarray, rows_b: np.ndarray, same: bool, s: Settings):
        self.a, self.b, self.same, self.s = a, b, same, s
        self.rows_a, self.rows_b = rows_a, rows_b  # multiplicities
        self.sums_a, self.sums_b = (np.concatenate([[0], np.cumsum(r)]) for r in (rows_a, rows_b))
        self.links_a, self.links_b = np.zeros(len(rows_a), dtype=np.int64), np.zeros(len(rows_b), dtype=np.int64)
        self.shift = 0 if same else len(rows_a)
        self.sets = Union(len(rows_a) + (0 if same else len(rows_b)))

    def run(self) -> None:
        last = len(self.a.levels) - 1
        stack = [(0, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
        while stack:
            level, x, y = stack.pop()
            for i, j, dots in self._children(level, x, y):
                if self.same:
                    # Below a pair of one node with itself, each pair of children is seen once.
                    keep = i <= j if level + 1 < last else i < j
                    i, j, dots = i[keep], j[keep], None if dots is None else dots[keep]
                i, j = self._near(level + 1, i, j, dots)
                if not len(i):
                    continue
                if level + 1 == last:
                    self._decide(i, j)
                else:
                    stack.append((level + 1, i, j))

    def _children(self, level: int, x: np.ndarray, y: np.ndarray):
        """Pairs of children, a bounded number at a time, with the products of their centres where these are known."""
        first_a, first_b = self.a.levels[level][4], self.b.levels[level][4]
        na, nb = first_a[x + 1] - first_a[x], first_b[y + 1] - first_b[y]
        total = na * nb
        at = 0
        while at < len(x):
            to = at + max(1, int(np.searchsorted(np.cumsum(total[at:]), STEP, side="right")))
            if to == at + 1 and total[at] > STEP:
                rows = max(1, STEP // int(nb[at]))
                own = self.same and x[at] == y[at]
                for r in range(0, int(na[at]), rows):
                    i = np.arange(first_a[x[at]] + r, min(first_a[x[at]] + r + rows, first_a[x[at] + 1]))
                    j = np.arange(i[0] if own else first_b[y[at]], first_b[y[at] + 1])
                    yield from self._dense(level + 1, i, j)
            else:
                part = slice(at, to)
                of = np.repeat(np.arange(to - at), total[part])
                inner = np.arange(len(of)) - np.repeat(np.cumsum(total[part]) - total[part], total[part])
                yield first_a[x[part]][of] + inner // nb[part][of], first_b[y[part]][of] + inner % nb[part][of], None
            at = to

    def _dense(self, level: int, i: np.ndarray, j: np.ndarray):
        """Of all pairs of two ranges of nodes, those not too far apart, by one product of matrices."""
        ca, ra = self.a.levels[level][2:4]
        cb, rb = self.b.levels[level][2:4]
        # Nodes of one vector have no radius. They are most of the nodes in data without structure, and need
        # one threshold for each of the other side's nodes instead of one for each pair.
        for rows in (i[ra[i] == 0], i[ra[i] > 0]):
            if len(rows):
                dots = self.a.single[ca[rows]] @ self.b.single[cb[j]].T
                spread = rb[j][None, :] if ra[rows[0]] == 0 else ra[rows][:, None] + rb[j][None, :]
                least = (1 - (self.s.reach + SLACK + spread) ** 2 / 2).astype(np.float32)
                found = np.flatnonzero(dots >= least)
                yield rows[found // len(j)], j[found % len(j)], dots.ravel()[found]

    def _near(self, level: int, i: np.ndarray, j: np.ndarray, dots: np.ndarray | None = None):
        """Drop pairs that are too far apart; count and drop those that are linked as a whole."""
        ca, ra = self.a.levels[level][2:4]
        cb, rb = self.b.levels[level][2:4]
        if dots is None:
            dots = np.empty(len(i), dtype=np.float32)
            for at in range(0, len(i), 1 << 16):
                x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                dots[at : at + (1 << 16)] = np.einsum("ij,ij->i", self.a.single[ca[x]], self.b.single[cb[y]])
        apart = _distance(dots)
        spread = ra[i] + rb[j]
        whole = apart + spread <= self.s.reach - SLACK
        if whole.any():
            self._link_whole(level, i[whole], j[whole])
        near = ~whole & (apart <= self.s.reach + spread + SLACK)
        return i[near], j[near]

    def _link_whole(self, level: int, i: np.ndarray, j: np.ndarray) -> None:
        start_a, end_a = self.a.levels[level][:2]
        start_b, end_b = self.b.levels[level][:2]
        for x, y in zip(i.tolist(), j.tolist()):
            xs, ys = slice(start_a[x], end_a[x]), slice(start_b[y], end_b[y])
            if self.same and x == y:
                self.links_a[xs] += self.sums_a[end_a[x]] - self.sums_a[start_a[x]] - self.rows_a[xs]
            else:
                self.links_a[xs] += self.sums_b[end_b[y]] - self.sums_b[start_b[y]]
                (self.links_a if self.same else self.links_b)[ys] += self.sums_a[end_a[x]] - self.sums_a[start_a[x]]
            members = np.concatenate([np.arange(xs.start, xs.stop), np.arange(ys.start, ys.stop) + self.shift])
            self.sets.unite(members, np.full(len(members), members[0]))

    def _decide(self, i: np.ndarray, j: np.ndarray) -> None:
        """Single vectors: the cosine in double precision."""
        linked = np.empty(len(i), dtype=bool)
        for at in range(0, len(i), 1 << 15):
            x, y = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
            linked[at : at + (1 << 15)] = np.einsum("ij,ij->i", self.a.vectors[x], self.b.vectors[y]) >= self.s.cosine
        i, j = i[linked], j[linked]
        if len(i):
            self.links_a += np.bincount(i, self.rows_b[j], len(self.links_a)).astype(np.int64)
            target = self.links_a if self.same else self.links_b
            target += np.bincount(j, self.rows_a[i], len(target)).astype(np.int64)
            self.sets.unite(i, j + self.shift)


def _blocked(s: Settings):
    """Rows of one block, with their paths in its cover tree and the ball that holds the block."""

    def each(block: pd.DataFrame) -> pd.DataFrame:
        vectors = unit(block["data"])
        paths = cover_paths(vectors, s.radii)
        order = np.lexsort(paths.T[::-1])
        block, paths = block.iloc[order], paths[order]
        return pd.DataFrame({"block": block["block"], "node": block["node"], "n": block["n"], "data": block["data"],
                             "place": np.arange(len(block)), "path": list(paths)})

    return each


def _balls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of the unit vectors of each block and task."""
    for batch in batches:
        for (block, dim), rows in batch.groupby(["block", "dim"]):
            yield pd.DataFrame({"block": [block], "dim": [dim], "total": [unit(rows["data"]).sum(axis=0)]})


def _compared(s: Settings):
    """The links of one pair of blocks."""

    def each(pair: pd.DataFrame) -> pd.DataFrame:
        trees, parts = [], []
        for _, rows in pair.groupby("block"):
            rows = rows.sort_values("place")
            parts.append(rows)
            trees.append(Tree(unit(rows["data"]), np.stack(rows["path"].to_numpy())))
        same = len(trees) == 1
        rows = [p["n"].to_numpy() for p in parts]
        t = Traversal(trees[0], trees[-1], rows[0], rows[-1], same, s)
        t.run()
        node = np.concatenate([p["node"].to_numpy() for p in parts])
        links = t.links_a if same else np.concatenate([t.links_a, t.links_b])
        found = np.flatnonzero(links)
        return pd.DataFrame({"node": node[found], "other": node[t.sets.find(found)], "n": links[found]})

    return each


def _partners(centres: np.ndarray, radii: np.ndarray, dims: np.ndarray, names: np.ndarray, s: Settings):
    """For each block the pairs (smaller, larger) it is part of, as a list of the other blocks."""
    where = {int(b): k for k, b in enumerate(names)}

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for b in batch["block"]:
                k = where[int(b)]
                apart = np.sqrt(((centres - centres[k]) ** 2).sum(axis=1))
                near = (dims == dims[k]) & (apart <= radii + radii[k] + s.reach + SLACK)
                found += [(int(b), min(int(b), int(x)), max(int(b), int(x))) for x in names[near]]
            yield pd.DataFrame(found, columns=["block", "low", "high"])

    return each


def _nearest(pivots: dict[int, np.ndarray]):
    def each(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for data, dims in batches:
            cells = np.zeros(len(data), dtype=np.int64)
            for dim in dims.unique():
                own = np.flatnonzero(dims == dim)
                if dim in pivots:
                    cells[own] = (unit(data.iloc[own]) @ pivots[dim].T).argmax(axis=1)
            yield pd.Series(cells)

    return F.pandas_udf(each, "long")


def _links(classes: DataFrame, s: Settings) -> DataFrame:
    """node, other, n: for each class and pair of blocks, how many rows it links to, and a class it hangs together with."""
    spark = classes.sparkSession
    total = classes.count()
    wanted = min(s.pivots, max(1, total // s.block))
    # Pivots are bounded in number by a setting.
    drawn = classes.orderBy(F.xxhash64("node")).limit(wanted).select("dim", "data").toPandas()
    pivots = {int(d): unit(g["data"]) for d, g in drawn.groupby("dim")}
    celled = stored(classes.withColumn("cell", _nearest(pivots)("data", "dim")), "cells")
    parts = celled.groupBy("dim", "cell").agg(F.ceil(F.count("*") / (1.25 * s.block)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    # A block's name is unique: its length of vectors, cell and part.
    name = F.col("dim").cast("long") * (1 << 40) + F.col("cell") * (1 << 24) + part
    dealt = celled.join(parts, ["dim", "cell"]).withColumn("block", name)
    fields = "block long, node long, n long, data binary, place int, path array<int>"
    blocks = stored(dealt.select("block", "node", "n", "data").groupBy("block").applyInPandas(_blocked(s), fields), "blocks")
    dim = F.length("data") / 8
    sums = blocks.select("block", "data", dim.cast("int").alias("dim")).mapInPandas(_balls, "block long, dim int, total array<double>")
    means = sums.groupBy("block", "dim").agg(F.collect_list("total").alias("totals")).toPandas()
    if not len(means):
        return spark.createDataFrame([], "node long, other long, n long")
    names, dims = means["block"].to_numpy(), means["dim"].to_numpy()
    width = int(dims.max())
    centres = np.zeros((len(means), width))
    for k, totals in enumerate(means["totals"]):
        mean = np.sum([np.asarray(t) for t in totals], axis=0)
        size = np.sqrt((mean * mean).sum())
        centres[k, : dims[k]] = mean / size if size else np.eye(1, dims[k])[0]
    at = {int(b): centres[k, : dims[k]] for k, b in enumerate(names)}

    def farthest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, rows in batch.groupby("block"):
                apart = np.sqrt(((unit(rows["data"]) - at[int(block)]) ** 2).sum(axis=1)).max()
                yield pd.DataFrame({"block": [block], "radius": [apart]})

    spans = blocks.select("block", "data").mapInPandas(farthest, "block long, radius double")
    spans = {r["block"]: r["radius"] for r in spans.groupBy("block").agg(F.max("radius").alias("radius")).collect()}
    radii = np.array([spans[int(b)] for b in names])
    listed = blocks.select("block").distinct().mapInPandas(
        _partners(centres, radii, dims, names, s), "block long, low long, high long"
    )
    pairs = blocks.join(listed, "block")
    return pairs.groupBy("low", "high").applyInPandas(_compared(s), "node long, other long, n long")


def linked(df: DataFrame, vec_id="vec_id", embedding="embedding", s: Settings = Settings()) -> DataFrame:
    """One row per row of ``df``: the id, n_links, component_id, kept."""
    rows = df.select(column(vec_id).alias("id"), column(embedding).alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    valid = F.coalesce((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    usable = rows.filter(valid)
    grouped = usable.groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    data = F.pandas_udf(_bytes, "binary")("v")
    classes = stored(
        grouped.select(F.monotonically_increasing_id().alias("node"), "v", "low", "n", F.size("v").alias("dim"), data.alias("data")),
        "classes",
    )
    links = stored(_links(classes.select("node", "n", "dim", "data"), s), "links")
    roots = stored(connected_components(links.select(F.col("node").alias("a"), F.col("other").alias("b"))), "components")
    counts = links.groupBy("node").agg(F.sum("n").alias("others"))
    lows = classes.join(roots, "node").groupBy("root").agg(F.min("low").alias("root_low"))
    known = (
        classes.select("node", "v", "low", "n")
        .join(counts, "node", "left")
        .join(roots, "node", "left")
        .join(lows, "root", "left")
        .select(
            "v",
            (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("root_low", "low").alias("component"),
        )
    )
    known = stored(known, "known")
    found = usable.join(known, "v").select("id", "n_links", "component")
    alone = rows.filter(~valid).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return found.unionByName(alone).select(
        F.col("id").alias(vec_id),
        "n_links",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"),
    )
