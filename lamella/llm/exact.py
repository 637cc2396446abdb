"""Exact duplicates by composable polynomial fingerprints.

A text is lower-cased (A-Z only) and read as UTF-8 bytes ``b0 b1 ...``. Its fingerprint is the sum of
``b_i * base**i`` modulo two primes, with its length. Fingerprints of neighbouring chunks combine:
``H(xy) = H(x) + base**len(x) * H(y)``, so the chunks of a huge text are hashed by different tasks.
Texts of equal fingerprints are then compared chunk by chunk with one text of their group, spread
over tasks by fingerprint, chunk and a salt; no task holds a group.

Null texts count as empty. Null ids are allowed: they are smaller than any id. Rows alike in id and
text are one document written several times; the first of them stays. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import column, fold_ascii, fresh, one_row_each, stored

#: Two primes below 2**31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1150833019, 1853820533)

#: Bytes hashed at a time; a product with a byte is below 2**39, so a sum over these stays below 2**63.
STEP = 1 << 16


@lru_cache(maxsize=4)
def _powers(prime: int, base: int) -> np.ndarray:
    found = np.empty(STEP, dtype=np.uint64)
    found[0] = 1
    known = 1
    while known < STEP:
        more = min(known, STEP - known)
        found[known : known + more] = found[:more] * np.uint64(pow(base, known, prime)) % np.uint64(prime)
        known += more
    return found


def combine(x: tuple[int, int, int], y: tuple[int, int, int]) -> tuple[int, int, int]:
    """The fingerprint of a text from those of its first and second part; each is (length, h1, h2)."""
    shifted = [(x[1 + k] + pow(BASES[k], x[0], PRIMES[k]) * y[1 + k]) % PRIMES[k] for k in (0, 1)]
    return x[0] + y[0], shifted[0], shifted[1]


def fingerprint(data: bytes) -> tuple[int, int, int]:
    """(length, h1, h2) of bytes, a step at a time."""
    whole = (0, 0, 0)
    for at in range(0, len(data), STEP):
        part = np.frombuffer(data, dtype=np.uint8, count=min(STEP, len(data) - at), offset=at).astype(np.uint64)
        sums = [int((part * _powers(p, b)[: len(part)]).sum()) % p for p, b in zip(PRIMES, BASES)]
        whole = combine(whole, (len(part), *sums))
    return whole


def _digests(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        data = (text or "").encode().lower()  # bytes.lower() folds A-Z only
        rows.append((*fingerprint(data), hashlib.sha256(data).hexdigest()))
    return pd.DataFrame(rows, columns=["size", "h1", "h2", "sha256"])


def _chunk_prints(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fingerprint(t.encode().lower()) for t in texts], columns=["size", "h1", "h2"])


def _merge_prints(parts: pd.Series) -> pd.DataFrame:
    rows = []
    for chunks in parts:
        whole = (0, 0, 0)
        for c in sorted(chunks, key=lambda c: c["k"]):
            whole = combine(whole, (c["size"], c["h1"], c["h2"]))
        rows.append(whole)
    return pd.DataFrame(rows, columns=["size", "h1", "h2"])


def fingerprinted(df: DataFrame, key: str, text: str, huge: int = 4 << 20) -> DataFrame:
    """``df`` with its fingerprint as struct ``key`` (size, h1, h2, sha256).

    Texts of over ``huge`` characters are cut into chunks of that length, which are dealt out and
    hashed apart; their fingerprints are then put together. All columns come through.
    """
    content = column(text)
    is_huge = F.coalesce(F.length(content) > huge, F.lit(False))
    digests = F.pandas_udf(_digests, "size long, h1 long, h2 long, sha256 string")
    plain = df.filter(~is_huge).withColumn(key, digests(content))
    # A huge text goes by its own digest, so that rows without a usable id can be told apart.
    (name,) = fresh(df, "text_name")
    large = df.filter(is_huge).withColumn(name, F.sha2(fold_ascii(content), 256))
    prints = F.pandas_udf(_chunk_prints, "size long, h1 long, h2 long")
    merged = F.pandas_udf(_merge_prints, "size long, h1 long, h2 long")
    chunks = (
        large.select(F.col(name).alias("name"), content.alias("text"))
        .select("name", "text", F.explode(F.expr(f"sequence(0, (length(text) - 1) div {huge})")).alias("k"))
        .select("name", "k", F.expr(f"substring(text, CAST(k * {huge} + 1 AS INT), {huge})").alias("part"))
        .repartition("name", "k")
        .select("name", "k", prints("part").alias("p"))
        .dropDuplicates(["name", "k"])
    )
    whole = chunks.groupBy("name").agg(F.collect_list(F.struct("k", "p.size", "p.h1", "p.h2")).alias("parts"))
    whole = whole.select(F.col("name").alias(name), merged("parts").alias(key))
    with_digest = F.struct(*[F.col(key)[f].alias(f) for f in ("size", "h1", "h2")], F.col(name).alias("sha256"))
    large = large.join(whole, name).withColumn(key, with_digest)
    return plain.unionByName(large.drop(name))


PRINT = ["size", "h1", "h2"]


def _same_member(x: DataFrame, y: DataFrame):
    return x["id"].eqNullSafe(y["id"]) & (x["sha256"] == y["sha256"])


def _unlike(printed: DataFrame, groups: DataFrame, chunk: int, together: int) -> DataFrame:
    """Members (id, sha256) whose text is not that of the row that would stay for their fingerprint.

    Texts are cut into chunks, and each is compared with the same chunk of the row that stays. A salt
    spreads the members of a large group; the row that stays is repeated once for each salt, which
    is once for ``together`` members.
    """
    shared = groups.filter("members > 1").select(*PRINT, "stay", "members")
    part = F.expr(
        f"transform(sequence(0, greatest(length(text) - 1, 0) div {chunk}),"
        f" k -> substring(text, CAST(k * {chunk} + 1 AS INT), {chunk}))"
    )
    pieces = (
        printed.withColumn("text", fold_ascii(F.coalesce("text", F.lit(""))))
        .join(shared, PRINT)
        .withColumn("stays", F.col("id").eqNullSafe(F.col("stay.id")) & (F.col("sha256") == F.col("stay.sha256")))
        .withColumn("salts", (F.col("members") / together).cast("int"))
        .select(*PRINT, "id", "sha256", "stays", "salts", F.posexplode(part).alias("k", "part"))
    )
    pieces = stored(pieces, "pieces")  # read twice below
    stay = (
        pieces.filter("stays")
        .select(*PRINT, "k", F.col("part").alias("wanted"), F.explode(F.sequence(F.lit(0), "salts")).alias("salt"))
        .dropDuplicates([*PRINT, "k", "salt"])
    )
    others = pieces.filter("NOT stays").withColumn("salt", F.pmod(F.xxhash64("id", "sha256"), F.col("salts") + 1).cast("int"))
    return others.join(stay, [*PRINT, "k", "salt"]).filter("part <> wanted").select("id", "sha256").distinct()


def exact_groups(
    df: DataFrame, doc_id: str, text: str, huge: int = 4 << 20, chunk: int = 1 << 16, together: int = 64
) -> DataFrame:
    """One row per different (id, text): id, size, h1, h2, sha256, n (rows), stay (id, sha256), group_size.

    Members found unlike the row that stays share its fingerprint by chance; they form groups of
    their own in a further round, until every group holds one text.
    """
    docs = df.select(column(doc_id).alias("id"), column(text).alias("text"))
    printed = fingerprinted(docs, "print", "text", huge).select("id", "text", "print.*")
    left = stored(printed.groupBy("id", *PRINT, "sha256").agg(F.count("*").alias("n")), "prints")
    result, rounds = None, 0
    while True:
        groups = stored(_grouped(left), "groups")
        texts = printed.join(left, _same_member(printed, left), "left_semi") if rounds else printed
        unlike = stored(_unlike(texts, groups, chunk, together), "unlike")
        last = unlike.isEmpty()
        settled = left if last else stored(left.join(unlike, _same_member(left, unlike), "left_anti"), "settled")
        groups = groups if last else stored(_grouped(settled), "groups")
        found = settled.join(groups.drop("members"), PRINT)
        result = found if result is None else result.unionByName(found)
        if last:
            return result
        left = stored(left.join(unlike, _same_member(left, unlike), "left_semi"), "prints")
        rounds += 1


def _grouped(members: DataFrame) -> DataFrame:
    return members.groupBy(*PRINT).agg(
        F.max(F.struct("id", "sha256")).alias("stay"),
        F.sum("n").alias("group_size"),
        F.count("*").alias("members"),
    )


def exact_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of ``df``: the id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays.
    """
    groups = exact_groups(df, doc_id, text, **options)
    first = F.col("copy") == 1
    return groups.withColumn("copy", F.explode(F.expr("sequence(1, n)"))).select(
        F.col("id").alias(doc_id),
        F.col("stay.id").alias("keep_id"),
        "group_size",
        (F.col("id").eqNullSafe(F.col("stay.id")) & (F.col("sha256") == F.col("stay.sha256")) & first).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


def drop_exact_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    groups = exact_groups(df, doc_id, text, **options)
    key, i, sha, n = fresh(df, "print", "kept_id", "kept_sha256", "copies")
    kept = groups.filter(F.col("id").eqNullSafe(F.col("stay.id")) & (F.col("sha256") == F.col("stay.sha256")))
    kept = kept.select(F.col("id").alias(i), F.col("sha256").alias(sha), F.col("n").alias(n))
    printed = fingerprinted(df, key, text, options.get("huge", 4 << 20))
    same = column(doc_id).eqNullSafe(F.col(i)) & (F.col(key)["sha256"] == F.col(sha))
    rows = one_row_each(printed.join(kept, same), [i, sha], n)
    return rows.select(*[column(c) for c in df.columns])
