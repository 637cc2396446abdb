"""Hard negatives against a brute-force version in Python's integers."""

from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm import negatives
from lamella.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=50):
    kept = {}
    for id_, vector, label in rows:
        if id_ is not None and vector is not None and label is not None and all(x is not None and isfinite(x) for x in vector):
            row = (str(label), [floor(256 * x) for x in vector])
            kept.setdefault(id_, row)
    out = []
    for a, (label, vector) in kept.items():
        if a % every:
            continue
        found = []
        for b, (other, w) in kept.items():
            score = sum(x * y for x, y in zip(vector, w))
            if b != a and len(w) == len(vector) and -(2**63) <= score < 2**63:
                found.append((-score, b, other == label))
        found.sort()
        for score, p, _ in [x for x in found if x[2]][:5]:
            fits = [x for x in found if not x[2] and 50 * -score <= 100 * -x[0] <= 95 * -score][:3]
            out += [(a, p, k + 1, x[1], -score, -x[0]) for k, x in enumerate(fits)]
    return sorted(out)


def mined(df, settings=negatives.Settings(), every=50):
    return sorted(tuple(r) for r in negatives.mined(df, F.col("id") % every == 0, settings=settings).collect())


def test_query_agrees_with_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    rows = [(i, v, None if y is None else (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows]
    assert sorted(tuple(r) for r in QUERIES["op13_negatives"](spark, folder).collect()) == brute(rows)


SMALL = [
    negatives.Settings(),
    negatives.Settings(block=20, group=3, references=3, bins=16),
    negatives.Settings(block=1, group=1, references=1, sample=5),
]


@pytest.mark.parametrize("settings", SMALL)
def test_clusters_copies_and_ties(spark, settings):
    r = np.random.default_rng(3)
    centres = r.normal(size=(4, 6)) * 3
    rows = [(k, (centres[k % 4] + r.normal(size=6) * 0.4).round(1).tolist(), int(r.integers(3))) for k in range(160)]
    rows += [(200 + k, rows[0][1], k % 2) for k in range(60)]  # a group of copies
    rows += [(300 + k, (-centres[0]).tolist(), 0) for k in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert mined(df, settings, every=10) == brute(rows, every=10)


@pytest.mark.parametrize("settings", SMALL[:2])
def test_edges(spark, settings):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (1, [1.0, 0.4], 1), (2, [0.6, 0.4], 2), (3, [0.0, 0.0], 1), (4, [0.0, 0.0], 2),
        (5, None, 1), (6, [1.0, None], 2), (7, [nan, 1.0], 2), (8, [inf, 1.0], 2), (9, [1.0, 0.5], None), (None, [1.0, 0.5], 2),
        (11, [], 1), (50, [], 1), (12, [], 2), (13, [1.0, 2.0, 3.0], 2), (14, [0.7, 0.3], 2), (14, [0.7, 0.3], 2), (15, [-1.0, -1.0], 2),
        (100, [-1.0, -0.9], 1), (150, [1e200, 1.0], 1), (16, [1e17, 1.0], 2), (17, [1e12, 1.0], 2), (200, [3e4, 1e4], 1), (18, [0.001, 2e4], 2),
        (19, [-0.001, 5.0], 2), (250, [0.0, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS id", "1 AS block", "'y' AS size", "0 AS bin")
    assert mined(df, settings) == brute(rows)
    assert mined(df.limit(0), settings) == []
    assert mined(df.filter("vec_id = 0"), settings) == []
    assert mined(df.filter("vec_id % 50 <> 0"), settings) == []


def test_bounds_hold_and_prune():
    r = np.random.default_rng(5)
    for size in (2, 5, 40):
        vectors = np.floor(r.normal(size=(200, size)) * 100 * 10.0 ** r.integers(-1, 4, size=(200, 1)))
        references = r.normal(size=(4, size))
        references /= np.linalg.norm(references, axis=1, keepdims=True)
        rows = negatives.Rows.__new__(negatives.Rows)
        rows.angles, rows.norms = negatives._angles(vectors, references), negatives._norms(vectors)
        every = np.arange(len(vectors))
        span = (np.array([rows.norms.max()]), rows.angles.min(axis=0)[None, :], rows.angles.max(axis=0)[None, :])
        dropped = 0
        for k in range(50):
            scores = vectors @ vectors[k]
            low, high = negatives.row_bounds(rows.norms[k], rows.angles[k], rows, every)
            assert (low <= scores).all() and (scores <= high).all()
            dropped += (high < scores.max() / 2).sum()
            low, high = negatives.bounds(rows.norms[k], rows.angles[k], *span)
            assert low[0] <= scores.min() and scores.max() <= high[0]
        if size == 2:
            assert dropped > 5000  # of 10,000: angles tell much in few dimensions
