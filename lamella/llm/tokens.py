"""Encoding whole texts by a public tokenizer, and the exact histogram of encoded lengths.

Tokenizers that drop white space encode a text word by word: no token spans a blank, so what a word becomes
does not depend on its neighbours. A worker remembers the words it has met, up to a bound, and joins their ids.
Texts with one of the four separators that only Python takes for white space are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamella.llm.common import column, stored

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: Separators that str.split() cuts at and Unicode does not call white space.
NOT_BLANK = "\x1c\x1d\x1e\x1f"
#: Runs of ASCII marks without the apostrophe, which tokenizers of this kind take apart from letters and digits.
MARKS = re.compile(r"[!-&(-/:-@\[-`{-~]+")

def simple(text: str) -> bool:
    """Without control strings, and with letters whose lower case is a single letter with a code below 256."""
    if "<|" in text:
        return False
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit bytes. For byte-level tokenizers that lower-case,
    drop white space and mark the end of a word."""

    def __init__(self, path: str = TOKENIZER, remembered: int = 60_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core already
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        self.known: dict[str, bytes] = {}
        # Lower-case letters need no normalizing and no pattern: blanks separate them, and each word ends in a token
        # whose text says so. Byte-level vocabularies write the bytes of other letters as characters of their own.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        mapped = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {chr(c): mapped.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x100)}

    def learn(self, words: list[str]) -> None:
        """Remember the ids of words met for the first time."""
        known, plain, odd = self.known, [], []
        for w in words:
            (plain if w.isalpha() and w.islower() and w[-1] < "\u0100" and max(w) < "\u0100" else odd).append(w)
        for w, found in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
            known[w] = np.array(found.ids, dtype="<u4").tobytes()
        for at in range(0, len(plain), 8192):
            part = plain[at : at + 8192]
            text = " ".join(part)
            for c in set(text):
                if c in self.letters:
                    text = text.replace(c, self.letters[c])
            ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            data, ends = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            known.update(zip(part, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def words(self, text: str | None) -> list[str] | None:
        """What encodes apart from each other: white space and, in simple texts, runs of marks are the borders."""
        if not text:
            return []
        if any(c in text for c in NOT_BLANK):
            return None
        if not simple(text):
            return text.split()
        return MARKS.sub(r" \g<0> ", text.lower()).split()

    def encode(self, texts) -> list[bytes]:
        """The ids of each whole text; a null text has none."""
        if len(self.known) > self.remembered:
            self.known.clear()
        split = [self.words(t) for t in texts]
        unknown = set().union(*filter(None, split)) - self.known.keys()
        if unknown:
            self.learn(list(unknown))
        get = self.known.__getitem__
        return [
            b"".join(map(get, words))
            if words is not None
            else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
            for t, words in zip(texts, split)
        ]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process, which outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def in_parts(texts: pd.Series, characters: int = 1 << 21) -> Iterator[list]:
    """The texts of a batch, a bounded number of characters at a time."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= characters:
            yield part
            part, size = [], 0
    if part:
        yield part


def token_counts(path: str = TOKENIZER):
    """A column function: text to its number of ids; null counts as empty."""

    def each(texts: pd.Series) -> pd.Series:
        encode = encoder(path).encode
        return pd.Series([len(x) // 4 for part in in_parts(texts) for x in encode(part)], dtype="int64")

    return F.pandas_udf(each, "long")


def length_histogram(df: DataFrame, text: str = "text", path: str = TOKENIZER, block: int = 128) -> DataFrame:
    """For every encoded length that occurs, exact answers for a context limit of that many tokens.

    Columns: length, n_docs (of this length), docs_at_most, docs_at_least, tokens_at_least (tokens of those documents),
    truncated_total (tokens left when every document is cut at the limit), total_docs, total_tokens, quantile (share of
    documents of at most this length). Limits in between need no row of their own: see ``at_limits``.

    Documents are aggregated by length first. Suffix sums run over blocks of lengths and then within each block, so
    that no task sees all lengths. Null and empty texts have length 0; ids play no part and repeated rows count as
    often as they occur. An empty table gives no rows.
    """
    lengths = df.select(token_counts(path)(column(text)).alias("length"))
    histogram = stored(lengths.groupBy("length").agg(F.count("*").alias("n_docs")), "lengths")
    own = histogram.withColumn("tokens", F.col("length") * F.col("n_docs"))
    own = own.withColumn("block", F.floor(F.col("length") / block))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each block, no more
    blocks = own.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("tokens"))
    totals = blocks.agg(F.sum("docs").alias("total_docs"), F.sum("tokens").alias("total_tokens"))
    above = blocks.select(
        "block",
        F.coalesce(F.sum("docs").over(after), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("tokens").over(after), F.lit(0)).alias("tokens_above"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    summed = own.join(above, "block").select(
        "length",
        "n_docs",
        (F.col("docs_above") + F.sum("n_docs").over(inside)).alias("docs_at_least"),
        (F.col("tokens_above") + F.sum("tokens").over(inside)).alias("tokens_at_least"),
    )
    first = totals.first()
    docs, tokens = first["total_docs"] or 0, first["total_tokens"] or 0
    at_most = F.lit(docs) - F.col("docs_at_least") + F.col("n_docs")
    return summed.select(
        "length",
        "n_docs",
        at_most.alias("docs_at_most"),
        "docs_at_least",
        "tokens_at_least",
        (F.lit(tokens) - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_total"),
        F.lit(docs).cast("long").alias("total_docs"),
        F.lit(tokens).cast("long").alias("total_tokens"),
        (at_most / F.lit(docs)).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> list[tuple[int, int]]:
    """(limit, tokens left when every document is cut there) for any limits, from a histogram."""
    found = []
    for limit in limits:
        r = histogram.filter(F.col("length") >= limit).orderBy("length").limit(1).first()
        if r is None:
            r = histogram.orderBy(F.desc("length")).limit(1).first()
            found.append((limit, r["total_tokens"] if r else 0))
        else:
            found.append((limit, r["total_tokens"] - r["tokens_at_least"] + limit * r["docs_at_least"]))
    return found
