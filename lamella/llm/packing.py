"""Packing documents into sequences of bounded length, balanced by attention cost.

A document of ``n`` tokens costs ``linear * n + quadratic * n * n`` within its sequence. Documents are encoded, ended by
one id and cut into full sequences and a remainder. Remainders are dealt by a hash of their row into groups of
bounded size; in each group the number of sequences is the least that holds its tokens, and remainders go, from the
longest down, to the sequence of lowest cost that has room for them. Where none has room, the remainder is cut and
fills the emptiest sequences. So a group wastes less than one sequence of padding, whatever the documents are.

What comes out is one row per piece: the document, where the piece starts in it, its length and checksum, and
where it lies (sequence, offset). Offsets are gapless.

Null and empty texts are the end id alone. Ids may be null or repeat: rows are told apart by a number given when
they are encoded, which is stored with their lengths. Very long texts give many full sequences, listed as an array.
An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import column, stored
from lamella.llm.tokens import TOKENIZER, encoder, in_parts


@dataclass(frozen=True)
class Settings:
    length: int = 2048  # tokens of a sequence
    end: int = 1  # id that ends a document
    linear: float = 1.0
    quadratic: float = 1.0 / 2048
    group: int = 2000  # documents packed together, about
    path: str = TOKENIZER


def _encoded(s: Settings):
    end = np.array([s.end], dtype="<u4").tobytes()
    step = 4 * s.length

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = encoder(s.path).encode
        for texts in batches:
            rows = []
            for part in in_parts(texts):
                for ids in encode(part):
                    ids += end
                    full = len(ids) // step * step
                    sums = [zlib.crc32(ids[at : at + step]) for at in range(0, full, step)]
                    rest = ids[full:]
                    rows.append((len(ids) // 4, sums, zlib.crc32(rest), rest))
            yield pd.DataFrame(rows, columns=["tokens", "full", "rest_crc32", "rest"])

    return F.pandas_udf(each, "tokens long, full array<long>, rest_crc32 long, rest binary")


class Rooms:
    """Sequences by the room they have left; finds the one of lowest cost with enough of it.

    A tree over the amounts of room holds the lowest cost below each node.
    """

    def __init__(self, sequences: int, length: int):
        self.size = 1 << length.bit_length()
        self.heaps: dict[int, list] = {}
        self.lowest = [(float("inf"), -1)] * (2 * self.size)
        if sequences:
            self.heaps[length] = [(0.0, k) for k in range(sequences)]
            self._update(length)

    def _update(self, room: int) -> None:
        heap, at = self.heaps.get(room), self.size + room
        self.lowest[at] = (heap[0][0], room) if heap else (float("inf"), -1)
        at //= 2
        while at:
            self.lowest[at] = min(self.lowest[2 * at], self.lowest[2 * at + 1])
            at //= 2

    def take(self, needed: int) -> tuple[int, float, int] | None:
        """Remove and return (sequence, cost, room) of the lowest cost with at least that room."""
        best, at = (float("inf"), -1), self.size + needed
        best = self.lowest[at]
        while at > 1:
            if not at & 1:
                best = min(best, self.lowest[at + 1])
            at //= 2
        return None if best[1] < 0 else self._pop(best[1])

    def emptiest(self) -> tuple[int, float, int]:
        """Remove and return the sequence with the most room."""
        at = 1
        while at < self.size:
            at = 2 * at + 1 if self.lowest[2 * at + 1][1] >= 0 else 2 * at
        return self._pop(at - self.size)

    def _pop(self, room: int) -> tuple[int, float, int]:
        cost, k = heapq.heappop(self.heaps[room])
        self._update(room)
        return k, cost, room

    def put(self, k: int, cost: float, room: int) -> None:
        if room:
            heapq.heappush(self.heaps.setdefault(room, []), (cost, k))
            self._update(room)


def pack(lengths: list[int], s: Settings) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start in it, length, sequence, offset) of items shorter than a sequence."""
    rooms = Rooms(-(-sum(lengths) // s.length), s.length)
    found = []

    def place(item: int, start: int, n: int, taken: tuple[int, float, int]) -> None:
        k, cost, room = taken
        found.append((item, start, n, k, s.length - room))
        rooms.put(k, cost + s.linear * n + s.quadratic * n * n, room - n)

    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[item]
        while left:
            taken = rooms.take(left)
            if taken is None:
                taken = rooms.emptiest()
            n = min(left, taken[2])
            place(item, start, n, taken)
            start, left = start + n, left - n
    return found


def _packed(s: Settings):
    def each(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row").reset_index(drop=True)
        base = int(group["part"].iloc[0]) << 32
        tokens = group["tokens"].to_numpy()
        full = tokens // s.length
        pieces = pack((tokens % s.length).tolist(), s)
        shared = max((p[3] for p in pieces), default=-1) + 1
        item = np.repeat(np.arange(len(group)), full)
        own = np.arange(len(item))
        first = np.cumsum(full) - full
        whole = pd.DataFrame(
            {
                "row": group["row"].to_numpy()[item],
                "start": (own - first[item]) * s.length,
                "length": s.length,
                "sequence_id": base + shared + own,
                "offset": 0,
                "cut": False,
            }
        )
        rest = pd.DataFrame(pieces, columns=["item", "start", "length", "sequence", "offset"], dtype="int64")
        at = rest["item"].to_numpy()
        rest = pd.DataFrame(
            {
                "row": group["row"].to_numpy()[at],
                "start": full[at] * s.length + rest["start"].to_numpy(),
                "length": rest["length"],
                "sequence_id": base + rest["sequence"],
                "offset": rest["offset"],
                "cut": rest["length"].to_numpy() != (tokens % s.length)[at],
            }
        )
        return pd.concat([whole, rest], ignore_index=True)

    return each


def packed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """One row per piece: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    encoded = df.select(column(doc_id).alias("id"), _encoded(s)(column(text)).alias("e"))
    encoded = stored(encoded.select(F.monotonically_increasing_id().alias("row"), "id", "e.*"), "encoded")
    groups = max(1, -(-encoded.count() // s.group))
    part = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")
    pieces = (
        encoded.select("row", "tokens", part.alias("part"))
        .groupBy("part")
        .applyInPandas(
            _packed(s), "row long, start long, length long, sequence_id long, offset long, cut boolean"
        )
    )
    pieces = stored(pieces, "pieces")
    known = encoded.select("row", "id", F.col("tokens").alias("doc_tokens"), "full", "rest_crc32")
    at = (F.col("start") / s.length).cast("int")
    own = F.when(at < F.size("full"), F.get("full", at)).otherwise(F.col("rest_crc32"))
    uncut = pieces.filter("NOT cut").join(known, "row").withColumn("ids_crc32", own)
    rest_start = F.col("tokens") - F.col("tokens") % s.length
    within = F.expr("substring(rest, CAST(4 * (start - rest_start) + 1 AS INT), CAST(4 * length AS INT))")
    cut = (
        encoded.select("row", "id", "tokens", "rest")
        .join(pieces.filter("cut"), "row")
        .withColumn("rest_start", rest_start)
        .withColumn("ids_crc32", F.crc32(within))
        .withColumnRenamed("tokens", "doc_tokens")
    )
    columns = [F.col("id").alias(doc_id), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return uncut.select(*columns).unionByName(cut.select(*columns))
