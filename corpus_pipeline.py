"""Documents to packed training sequences, stage by stage; every stage calls one operator of ``lamella.llm``.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept. All but the last
return the columns of ``documents``. Nulls, empty texts, repeated rows and empty tables are treated as the operators
say; columns beside those of ``documents`` come through all filtering stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamella.llm import exact, mixing, packing, simhash, toxicity
from lamella.llm.common import column, fresh, prepare, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. The model is learned from the labelled ones that are not held out."""
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"), folds=5, held=0)
    (score,) = fresh(docs, "toxicity")
    return toxicity.scored(docs, score, model).filter(column(score) < 0.5).drop(score)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, that of the largest id."""
    prepare(spark)
    return exact.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, that of the smallest id.

    Links are those of op2 and those of texts whose 5-word shingles have a Jaccard similarity of 0.8 or more.
    """
    prepare(spark)
    return simhash.drop_near_duplicates(docs, words=3, radius=3, least=0.8, set_words=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    prepare(spark)
    return mixing.mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, repeats included, in sequences of 2048 tokens."""
    prepare(spark)
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages of classifying, fingerprinting and tokenizing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and reread, as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
