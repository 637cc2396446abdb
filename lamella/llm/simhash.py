"""Near duplicates by SimHash and covering locality-sensitive hashing.

A fingerprint has 64 bits; a bit is set when it is set in over half of the hashes of the text's word
shingles. Two texts are linked when their fingerprints differ in at most ``radius`` bits.

Covering: every bit position gets a nonzero vector over GF(2) of ``radius + 1`` entries. Every nonzero
vector ``v`` gives a mask of the positions whose vector has an odd product with it. For any ``radius``
positions some ``v`` is orthogonal to all their vectors, so its mask avoids them: two fingerprints within
the radius agree under at least one of the ``2 ** (radius + 1) - 1`` masks. No link is missed, and no
threshold of luck is involved.

Copies share a fingerprint and are one row from then on. Buckets of over ``bucket`` fingerprints are not
compared pair by pair: the bits their mask leaves free are cut into ``radius + 1`` blocks, one of which has no
differing bit for any pair in reach, so the bucket falls apart into buckets under more bits, again and again.
With few free bits left a bucket cannot be large, so this ends, and nothing is capped. A bucket yields
links from its members to the smallest member they hang together with, never its pairs.

``jaccard_roots`` adds the links of texts whose sets of word shingles have a Jaccard similarity of at least
``least``. Shingles are ordered by hash, those that a sample finds common last. Of a set of ``n``, only its first
``n - ceil(least * n) + 1`` can hold the first shingle that it shares with a similar one, so similar texts
share one of those, and every such pair is found whatever the sample. Shingles whose texts are all linked already,
by fingerprints or by a text of two of the same lowest hashes, are passed over in an aggregate, so large groups of near
copies yield no pairs. The others' pairs are compared set by set. A pair that shares many of its first shingles comes from
the first of them only.

Null and empty texts have the fingerprint zero and are linked like any other. Null ids are allowed and are
passed over when the smallest id is looked for. Rows alike in id and text are one document written several
times. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import column, connected_components, forget, fresh, one_row_each, stored

BITS = 64
ALL = (1 << BITS) - 1
#: Shingles hashed at a time, so that very long texts need little memory.
STEP = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint of a whole text; zero without words."""
    found = (text or "").encode().lower().split()  # bytes: A-Z are folded, ASCII white space separates
    if not found:
        return 0
    if len(found) < words:
        found, words = [b" ".join(found)], 1
    hashed = map(partial(xxhash.xxh64_intdigest, seed=42), map(b" ".join, zip(*(found[k:] for k in range(words)))))
    left, ones = len(found) - words + 1, np.zeros(BITS, dtype=np.int64)
    total = left
    while left:
        n = min(STEP, left)
        part = np.fromiter(islice(hashed, n), dtype="<u8", count=n)
        ones += np.unpackbits(part.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        left -= n
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(words: int):
    """A column function: text to fingerprint, as a signed long."""

    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="uint64").astype("int64")

    return F.pandas_udf(each, "long")


def masks(radius: int) -> list[int]:
    """Masks under one of which any two fingerprints within the radius agree."""
    vectors = (1 << (radius + 1)) - 1
    given = [i % vectors + 1 for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(given) if (m & v).bit_count() & 1) for v in range(1, vectors + 1)]


def refined(mask: int, radius: int) -> list[int]:
    """Masks of more bits; two fingerprints within the radius that agree under ``mask`` agree under one of them."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    blocks = [free[k :: radius + 1] for k in range(radius + 1)]
    return sorted({mask | sum(1 << i for i in block) for block in blocks})


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def star_links(found: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of the members of a bucket to the smallest member they hang together with."""
    near = np.bitwise_count(found[:, None] ^ found[None, :]) <= radius
    open_, links = np.ones(len(found), dtype=bool), []
    order = np.argsort(found.view(np.int64), kind="stable")
    for i in order:
        if not open_[i]:
            continue
        open_[i] = False
        front = near[i] & open_
        while front.any():
            open_[front] = False
            links += [(int(x), int(found[i].view(np.int64))) for x in found[front].view(np.int64)]
            front = near[front].any(axis=0) & open_
    return links


def _linked(radius: int):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            links = []
            for bucket in batch["found"]:
                links += star_links(np.asarray(bucket, dtype=np.int64).view(np.uint64), radius)
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    return each


def covering_links(prints: DataFrame, radius: int = 3, bucket: int = 512) -> DataFrame:
    """Links ``a, b`` that connect all fingerprints (column ``fp``, distinct) within the radius of each other.

    Not every such pair has a link of its own, but the links connect what the pairs connect.
    """
    spark = prints.sparkSession
    fp = F.col("fp")
    level = masks(radius)
    keyed = prints.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(signed(m)).alias("mask"), fp.bitwiseAND(F.lit(signed(m))).alias("key")) for m in level])
        ).alias("t"),
    ).select("t.*", "fp")
    links = None
    while True:
        large = stored(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket), "large")
        last = large.isEmpty()
        small = keyed if last else keyed.join(large, ["mask", "key"], "left_anti")
        buckets = small.groupBy("mask", "key").agg(F.collect_list("fp").alias("found")).filter(F.size("found") > 1)
        found = buckets.select("found").mapInPandas(_linked(radius), "a long, b long")
        links = found if links is None else links.union(found)
        if last:
            return links
        level = sorted({m & ALL for (m,) in large.select("mask").distinct().collect()})
        finer = [(signed(m), signed(x)) for m in level for x in refined(m, radius)]
        finer = spark.createDataFrame(finer, "mask long, finer long")
        keyed = stored(
            keyed.join(large.select("mask", "key"), ["mask", "key"], "left_semi")
            .join(finer, "mask")
            .select(F.col("finer").alias("mask"), fp.bitwiseAND(F.col("finer")).alias("key"), "fp")
            .distinct(),
            "finer",
        )


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The different hashes of a whole text's word shingles, ascending; none without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, dtype="<i8")
    if len(found) < words:
        found, words = [b" ".join(found)], 1
    hashed = map(partial(xxhash.xxh64_intdigest, seed=42), map(b" ".join, zip(*(found[k:] for k in range(words)))))
    return np.unique(np.fromiter(hashed, dtype="<u8", count=len(found) - words + 1).view("<i8"))


def shingle_sets(words: int):
    """A column function: text to its set of shingles."""
    return F.pandas_udf(lambda texts: pd.Series([shingles(t, words) for t in texts], dtype="object"), "array<long>")


def _name(found: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(found.tobytes(), seed=7))


def set_names(words: int):
    """A column function: text to the digest of its set of shingles."""
    return F.pandas_udf(lambda texts: pd.Series([_name(shingles(t, words)) for t in texts], dtype="int64"), "long")


#: Buckets that the shingles of a set are counted in.
BUCKETS = 256


def profile(found: np.ndarray) -> bytes | None:
    """How many shingles of a set each bucket holds; none where a byte is too small for one.

    Two sets share no more shingles than the lesser of both counts, summed over the buckets.
    """
    counts = np.bincount(found.view("<u8") % BUCKETS, minlength=BUCKETS)
    return counts.astype("u1").tobytes() if counts.max() < 256 else None


#: Of the shingles that a set shares with others, the first ones, which tell whether a pair has been met before.
HEAD = 16

#: Bits of a parity sketch.
PARITIES = 1024


def parities(found: np.ndarray) -> np.ndarray:
    """For each bucket whether it holds an odd number of a set's shingles, as longs.

    Sketches of two sets differ in no more bits than the sets differ in shingles.
    """
    odd = np.bincount(found.view("<u8") % PARITIES, minlength=PARITIES) & 1
    return np.packbits(odd.astype("u1")).view("<i8")


def _near(least: float):
    """Whether two sets (size_a, parity_a; size_b, parity_b) can be similar by their sizes and sketches."""
    fits = F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b") - 1e-9
    bits = sum(F.bit_count(F.col("parity_a")[k].bitwiseXOR(F.col("parity_b")[k])) for k in range(PARITIES // 64))
    return fits & (bits <= (1 - least) / (1 + least) * (F.col("size_a") + F.col("size_b")) + 1e-6)


def _most_shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many shingles two sets can share by their profiles; null where one is unknown."""
    known = (a.notna() & b.notna()).to_numpy()
    most = np.full(len(a), np.nan)
    if known.any():
        x, y = (np.frombuffer(b"".join(s[known]), "u1").reshape(-1, BUCKETS) for s in (a, b))
        most[known] = np.minimum(x, y).sum(axis=1)
    return pd.Series(most)


def prefixes(words: int, least: float, common: dict[int, int], lowest: int = 4):
    """A column function: text to its set's digest and size, its lowest hashes, and the shingles similar texts share one of,
    and its profile."""
    known = np.array(sorted(common), dtype="<i8")
    weights = np.array([common[k] for k in sorted(common)], dtype="int64")

    def each(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found, n = shingles(text, words), 0
            if len(found):
                n = len(found) - math.ceil(least * len(found) - 1e-9) + 1
            weight = np.zeros(len(found), dtype="int64")
            if len(known):
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                weight = np.where(known[at] == found, weights[at], 0)
            first = found[np.lexsort((found, weight))[:n]]
            # The lowest hashes of the set, and those that are lowest in another order.
            other = np.sort(found * np.int64(-0x61C8864680B583EB))
            rows.append((_name(found), len(found), [found[:lowest], other[:lowest]], first, profile(found), parities(found)))
        return pd.DataFrame(rows, columns=["name", "size", "lowest", "first", "profile", "parity"])

    schema = "name long, size long, lowest array<array<long>>, first array<long>, profile binary, parity array<long>"
    return F.pandas_udf(each, schema)


def common_shingles(texts: DataFrame, words: int, sample: int = 20_000, often: int = 8, most: int = 100_000) -> dict[int, int]:
    """Shingles of over ``often`` texts of a sample. They only order shingles; which links are found does not depend on it."""
    share = min(1.0, sample / max(1, texts.count()))
    drawn = texts.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    counts = drawn.select(F.explode(shingle_sets(words)("text")).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    return {t: n for t, n in counts.filter(F.col("n") >= often).orderBy(F.desc("n"), "t").limit(most).collect()}


def _similar(texts: DataFrame, docs: DataFrame, pairs: DataFrame, words: int, least: float, prints: int) -> DataFrame:
    """Links ``a, b`` of fingerprints from pairs (fp_a, name_a, fp_b, name_b) whose sets are similar.

    Profiles, a quarter of a kilobyte each, tell most pairs that cannot be; only the sets of the others are compared.
    """
    asked, profiles = stored(pairs.distinct(), "pairs"), docs.select("fp", "name", "size", "profile").dropDuplicates(["fp", "name"])
    pairs = asked
    for x in "ab":
        pairs = pairs.join(profiles.toDF(*[f"{c}_{x}" for c in profiles.columns]), [f"fp_{x}", f"name_{x}"])
    most = F.pandas_udf(_most_shared, "double")(F.col("profile_a"), F.col("profile_b"))
    enough = F.coalesce(most >= least / (1 + least) * (F.col("size_a") + F.col("size_b")) - 1e-6, F.lit(True))
    pairs = stored(pairs.filter(enough).select(*asked.columns), "likely")
    forget(asked)
    a, b = [pairs.select(F.col(f"fp_{x}").alias("fp"), F.col(f"name_{x}").alias("name")) for x in "ab"]
    wanted = stored(a.union(b).distinct(), "wanted")
    ids = docs.join(wanted, ["fp", "name"], "left_semi").select(F.col("id").alias("wanted_id")).distinct()
    ids = stored(ids, "wanted-ids")  # its size is known then; where it is small, texts need no shuffle
    held = texts.join(ids, F.col("id").eqNullSafe(F.col("wanted_id")), "left_semi")
    # Not deterministic for Spark, or it would test the results for nulls on all texts, before the join.
    made = [f.asNondeterministic()("text") for f in (fingerprints(prints), set_names(words), shingle_sets(words))]
    held = held.select(*[f.alias(c) for f, c in zip(made, ("fp", "name", "set"))])
    held = stored(held.join(wanted, ["fp", "name"], "left_semi").groupBy("fp", "name").agg(F.first("set").alias("set")), "sets")
    likely = pairs
    for x in "ab":
        side = held.select(F.col("fp").alias(f"fp_{x}"), F.col("name").alias(f"name_{x}"), F.col("set").alias(f"set_{x}"))
        pairs = pairs.join(side, [f"fp_{x}", f"name_{x}"])
    shared = F.size(F.array_intersect("set_a", "set_b"))
    alike = shared / (F.size("set_a") + F.size("set_b") - shared) >= least
    found = stored(pairs.filter(alike).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).distinct(), "similar")
    forget(likely, wanted, ids, held)
    return found


def _pivot_links(texts, docs, sets: DataFrame, roots: DataFrame, order: int, words: int, least: float, prints: int) -> DataFrame:
    """Links of each text to one of the texts with the same lowest hash, the same for all of them: a few pairs per text."""
    rooted = sets.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    columns = ["root", "fp", "name", "size", "parity"]
    low = rooted.select(*columns, F.explode(F.col("lowest")[order]).alias("t"))
    chosen = F.min(F.struct(F.xxhash64("fp", F.lit(order)).alias("by"), *columns)).alias("p")
    pivots = low.groupBy("t").agg(chosen, F.min("root").alias("first"), F.max("root").alias("last")).filter("first <> last")
    pivots = pivots.select("t", *[F.col(f"p.{c}").alias(f"{c}_b") for c in columns])
    pairs = low.select("t", *[F.col(c).alias(f"{c}_a") for c in columns]).join(pivots, "t")
    pairs = pairs.filter((F.col("root_a") != F.col("root_b")) & _near(least)).select("fp_a", "name_a", "fp_b", "name_b")
    return _similar(texts, docs, pairs, words, least, prints)


def jaccard_roots(texts: DataFrame, docs: DataFrame, links: DataFrame, words: int, least: float, prints: int) -> DataFrame:
    """Components ``node, root`` of fingerprints under ``links`` and the links of similar sets.

    ``texts`` has id and text; ``docs`` has id, fp and what ``prefixes`` gives. Texts that hang together already are not
    compared, so two rounds of links to pivots come first: they bring most of a large group of near copies together.
    """
    sets = docs.filter("size > 0").select("fp", "name", "size", "lowest", "first", "parity")
    roots = stored(connected_components(links), "components")
    for order in (0, 1):
        more = _pivot_links(texts, docs, sets, roots, order, words, least, prints)
        stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        grown = stored(connected_components(stars.union(more)), "components")
        forget(roots, more)
        roots = grown

    rooted = sets.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    each = rooted.select("root", F.explode("first").alias("t"))
    mixed = each.groupBy("t").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("t")
    mixed = stored(mixed, "mixed")
    shared = sets.select("name", F.posexplode("first").alias("place", "t")).join(mixed, "t", "left_semi")
    shared = shared.groupBy("name").agg(F.sort_array(F.collect_set(F.struct("place", "t"))).alias("shared"))
    held = rooted.drop("lowest", "first").dropDuplicates(["fp", "name"]).join(shared, "name")
    head = F.slice(F.col("shared.t"), 1, HEAD).alias("head")
    held = held.select("root", "fp", "name", "size", "parity", head, F.explode("shared").alias("s"))
    rest = (F.col("size") - F.col("s.place") - 1).alias("rest")
    held = stored(held.select("s.t", "root", "fp", "name", "size", "parity", "head", rest), "held")
    columns = ("root", "fp", "name", "size", "parity", "head", "rest")
    a, b = [held.select("t", *[F.col(c).alias(f"{c}_{x}") for c in columns]) for x in "ab"]
    # The first shared shingle has this many behind it at most.
    room = 1 + F.least("rest_a", "rest_b") >= least / (1 + least) * (F.col("size_a") + F.col("size_b")) - 1e-9
    # A pair comes from the first shingle that both heads hold, in the order of shingles; without one, from any it shares.
    once = F.coalesce(F.get(F.array_intersect("head_a", "head_b"), F.lit(0)), F.col("t")) == F.col("t")
    pairs = a.join(b, "t").filter((F.col("root_a") < F.col("root_b")) & room & _near(least) & once)
    more = _similar(texts, docs, pairs.select("fp_a", "name_a", "fp_b", "name_b"), words, least, prints)
    forget(mixed, held)
    if more.isEmpty():
        return roots
    stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return stored(connected_components(stars.union(more)), "components")


def near_groups(
    df: DataFrame, doc_id: str, text: str, words: int, radius: int, least: float | None = None, set_words: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Documents (id, fp) and, for every fingerprint, its component (fp, component_id, first).

    With ``least``, texts of that Jaccard similarity of their shingles of ``set_words`` words are linked as well.
    """
    texts = df.select(column(doc_id).alias("id"), column(text).alias("text"))
    docs = texts.select("id", "text", fingerprints(words)("text").alias("fp"))
    if least is not None:
        docs = docs.withColumn("set", prefixes(set_words, least, common_shingles(texts, set_words))("text"))
    docs = stored(docs.select("id", "fp", *(["set.*"] if least is not None else [])), "simhash")
    prints = stored(docs.groupBy("fp").agg(F.min("id").alias("low")), "fingerprints")
    links = covering_links(prints.select("fp"), radius)
    if least is None:
        roots = stored(connected_components(links), "components")
    else:
        roots = jaccard_roots(texts, docs, links, set_words, least, words)
    in_links = prints.join(roots.withColumnRenamed("node", "fp"), "fp")
    lows = stored(in_links.groupBy("root").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "fp")).alias("first")), "lows")
    known = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").join(lows, "root", "left")
    alone = F.struct(F.col("low"), F.col("fp"))
    linked = F.struct(F.col("first.low").alias("low"), F.col("first.fp").alias("fp"))
    first = F.when(F.col("first").isNull(), alone).otherwise(linked)
    return docs, stored(known.select("fp", first.alias("first")), "components")


def simhash_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3
) -> DataFrame:
    """One row per row of ``df``: the id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    docs, components = near_groups(df, doc_id, text, words, radius)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return docs.join(components, "fp").select(
        F.col("id").alias(doc_id), hexed.alias("fingerprint"), F.col("first.low").alias("component_id")
    )


def drop_near_duplicates(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = 3,
    radius: int = 3,
    least: float | None = None,
    set_words: int = 5,
) -> DataFrame:
    """The rows of ``df`` with one document of each component left, that of the smallest id."""
    docs, components = near_groups(df, doc_id, text, words, radius, least, set_words)
    fp, i, kept_fp, n = fresh(df, "fp", "kept_id", "kept_fp", "copies")
    kept = components.filter(F.col("fp") == F.col("first.fp")).select(F.col("first.low").alias("id"), "fp")
    copies = docs.join(kept, docs["id"].eqNullSafe(kept["id"]) & (docs["fp"] == kept["fp"]), "left_semi")
    copies = copies.groupBy("id", "fp").agg(F.count("*").alias(n))
    copies = stored(copies.select(F.col("id").alias(i), F.col("fp").alias(kept_fp), n), "kept")
    printed = df.withColumn(fp, fingerprints(words)(column(text)))
    same = column(doc_id).eqNullSafe(F.col(i)) & (F.col(fp) == F.col(kept_fp))
    rows = one_row_each(printed.join(copies, same), [i, kept_fp], n)
    return rows.select(*[column(c) for c in df.columns])
