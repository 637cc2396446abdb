"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased and read as code points; whatever is not a letter becomes one blank. Its n-grams of one to
``longest`` characters are hashed into ``buckets`` cells. A language's model is the smoothed log probability of
each cell and the log share of its documents; the matrix goes to every task and texts are scored by summing its rows,
in numpy, over pieces of bounded length. The score is the posterior probability of the predicted language.

The cells are counted in about ``Settings.per_language`` documents of each language, drawn by a hash of their id, so that
rare languages are learned as well on large tables as on small ones; shares are those of all documents that may teach.
Languages are scored ``Settings.block`` at a time, so no matrix outgrows that, however many languages there are: each
further block is one more pass over the texts, whose best language and sum of probabilities are carried along.

Texts that are null or hold no letter are ``und`` with score 0. Rows with null ids are scored and never teach; rows
with a null language never teach. Without any row to learn from, every text is ``und``. Ties go to the language
that comes first by code point. Repeated rows are predicted alike.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamella.llm.common import column, fresh, learning_rows, stored

UNKNOWN = "und"
#: Code points scored at a time.
STEP = 1 << 16
#: Languages counted at a time in a task.
HELD = 64


@dataclass(frozen=True)
class Settings:
    per_language: int = 3_000  # documents of a language used for counting, about; drawn by a hash of the id
    buckets: int = 1 << 15  # a power of two
    longest: int = 3  # characters of an n-gram
    smoothing: float = 0.5
    block: int = 256  # languages scored in one pass


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def _points(text: str | None) -> np.ndarray | None:
    """Code points with single blanks (0) between words, or None without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kept = _letters()[points] if len(points) else np.zeros(0, dtype=bool)
    if not kept.any():
        return None
    points = np.where(kept, points, 0).astype(np.uint32)
    again = (points[1:] == 0) & (points[:-1] == 0)
    return np.concatenate([np.zeros(1, np.uint32), points[np.concatenate([[True], ~again])], np.zeros(1, np.uint32)])


def cells(points: np.ndarray, settings: Settings) -> Iterator[np.ndarray]:
    """Cells of the n-grams of every length, over pieces that overlap so that no n-gram is lost."""
    mask, overlap = np.uint32(settings.buckets - 1), settings.longest - 1
    for at in range(0, max(len(points) - overlap, 1), STEP):
        piece = points[at : at + STEP + overlap]
        rolled = np.zeros(len(piece), dtype=np.uint32)
        for n in range(1, settings.longest + 1):
            rolled = rolled[: len(piece) - n + 1] * np.uint32(0x01000193) + piece[n - 1 :] * np.uint32(n * 2 - 1)
            own = rolled[:STEP] if at + STEP + overlap < len(points) else rolled
            mixed = own * np.uint32(0x9E3779B1)
            yield (mixed ^ (mixed >> np.uint32(15))) & mask


def _counts(settings: Settings):
    def summed(found: dict) -> Iterator[pd.DataFrame]:
        for lang, counts in found.items():
            used = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "cell": used, "n": counts[used]})
        found.clear()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                points = _points(text)
                if points is None:
                    continue
                if lang not in found and len(found) >= HELD:
                    yield from summed(found)
                counts = found.setdefault(lang, np.zeros(settings.buckets, dtype=np.int64))
                for part in cells(points, settings):
                    counts += np.bincount(part, minlength=settings.buckets)
        yield from summed(found)

    return each


@dataclass(frozen=True)
class Block:
    """Some of the languages: what one pass over the texts needs."""

    languages: list
    priors: np.ndarray  # log share of documents
    weights: np.ndarray  # cell by language, log probabilities
    settings: Settings


@dataclass(frozen=True)
class Model:
    counts: DataFrame  # lang, cell, n
    languages: DataFrame  # lang, docs, share, block
    n_blocks: int
    settings: Settings

    def block(self, number: int) -> Block:
        """The matrix of one block on the driver: ``block`` times ``buckets`` cells at most."""
        own = self.languages.filter(F.col("block") == number)
        known = own.orderBy("lang").toPandas()
        found = self.counts.join(own.select("lang"), "lang").toPandas()
        matrix = np.full((self.settings.buckets, len(known)), self.settings.smoothing)
        matrix[found["cell"], found["lang"].map({x: k for k, x in enumerate(known["lang"])})] += found["n"]
        weights = (np.log(matrix) - np.log(matrix.sum(axis=0))).astype(np.float32)
        return Block(list(known["lang"]), np.log(known["share"].to_numpy(dtype=np.float64)), weights, self.settings)


def fitted(docs: DataFrame, settings: Settings = Settings(), folds: int = 4, held: int = 2) -> Model:
    """Learn from ``doc_id, text, lang`` of the rows that may teach."""
    rows = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & learning_rows(F.col("doc_id"), folds, held))
    totals = stored(rows.groupBy("lang").agg(F.count("*").alias("docs")), "languages")
    share = F.least(F.lit(1.0), settings.per_language / F.col("docs"))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)
    sample = rows.join(totals, "lang").filter(drawn).select("lang", "text")
    per_task = sample.repartition(max(8, totals.count())).mapInPandas(_counts(settings), "lang string, cell int, n long")
    counts = stored(per_task.groupBy("lang", "cell").agg(F.sum("n").alias("n")), "ngrams")
    # One row per language that has taught, numbered by code point.
    place = F.row_number().over(Window.orderBy("lang")) - 1
    known = totals.join(counts.select("lang").distinct(), "lang", "left_semi")
    known = known.withColumn("share", F.col("docs") / F.sum("docs").over(Window.partitionBy()))
    known = stored(known.withColumn("block", F.floor(place / settings.block)), "blocks")
    return Model(counts, known, -(-known.count() // settings.block), settings)


def scored(text: str | None, block: Block) -> tuple[str | None, float, float]:
    """The likeliest language of the block, its log probability with the text, and the log of the sum over the block."""
    points = _points(text)
    if points is None:
        return None, -np.inf, -np.inf
    total = block.priors.copy()
    for part in cells(points, block.settings):
        total += block.weights[part].sum(axis=0, dtype=np.float64)
    best = int(total.argmax())
    return block.languages[best], float(total[best]), float(total[best] + np.log(np.exp(total - total[best]).sum()))


def _one_pass(df: DataFrame, name: str, block: Block, text: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(block)

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([scored(t, shared.value) for t in texts], columns=["lang", "best", "whole"])

    return df.withColumn(name, F.pandas_udf(each, "lang string, best double, whole double")(column(text)))


def identified(df: DataFrame, name: str, model: Model, text: str = "text") -> DataFrame:
    """``df`` with a struct ``name`` of lang_pred and score, from the whole text."""
    if model.n_blocks == 0:
        return df.withColumn(name, F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")))
    sofar, more = fresh(df, "sofar", "more")
    out = _one_pass(df, sofar, model.block(0), text)
    for number in range(1, model.n_blocks):
        # Written between passes, so that workers hold one matrix at a time.
        out = _one_pass(stored(out, "languages-so-far"), more, model.block(number), text)
        old, new = column(sofar), column(more)
        high, low = F.greatest(old["whole"], new["whole"]), F.least(old["whole"], new["whole"])
        joined = F.struct(
            F.when(new["best"] > old["best"], new["lang"]).otherwise(old["lang"]).alias("lang"),
            F.greatest(old["best"], new["best"]).alias("best"),
            F.when(old["lang"].isNull(), old["whole"]).otherwise(high + F.log1p(F.exp(low - high))).alias("whole"),
        )
        out = out.withColumn(sofar, joined).drop(more)
    found = column(sofar)
    lang = F.coalesce(found["lang"], F.lit(UNKNOWN))
    score = F.when(found["lang"].isNull(), 0.0).otherwise(F.exp(found["best"] - found["whole"]))
    return out.withColumn(name, F.struct(lang.alias("lang_pred"), score.alias("score"))).drop(sofar)
