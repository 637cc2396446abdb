"""Alignment of two tokenizers over a corpus, by external spill counting.

Each whole text is cut by two tokenizers. Byte offsets where tokens of both end cut it into groups, and two tokens are
linked where their byte ranges overlap. How often the corpus links a pair of ids decides which links are the best of
their second id. So every link needs a count that only the whole corpus knows:

1. *Spill.* A block of documents (one Arrow batch) is tokenized. Its links become records (pair of ids, document, times),
   radix-partitioned by the second id; each radix of a block is one sorted run, compressed by zstd.
2. *Count.* Runs are merged by a k-way heap, a bounded number at a time, in the order of the second id. Each merge
   yields partial counts, which Spark sums by pair.
3. *Contribute.* Runs meet the counts of their radix and are merged again in the same order, so when an id's turn
   comes all its counts are there, their maximum too; what its links contribute streams back to the documents of
   each run. Radices with many runs are split into parts that each get the counts of the radix, so an id that holds a
   third of all links is worked on by many tasks. A part holds a bounded number of bytes and of runs, and counts
   of a radix are bounded by the vocabularies.

Null and empty texts, and texts whose tokens do not spell them (a tokenizer that normalizes), have no tokens: all
figures are zero and the digest is empty. Ids may be null or repeat: rows are told apart by block and place. A very
long text is a block of its own kind: links are computed for a bounded number of characters at a time, whole texts
each. An empty table gives no rows. Columns beside id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import column, stored
from lamella.llm.tokens import in_parts


@dataclass(frozen=True)
class Settings:
    first: str = public_tokenizers.path("byte_bpe_50k.json")  # byte-level, sees a blank before the text
    second: str = public_tokenizers.path("piece_bpe_32k.model")  # pieces, adds that blank itself
    radices: int = 64
    fan_in: int = 64  # runs merged at once
    part: int = 16 << 20  # bytes of the runs that one task merges, about
    part_runs: int = 4096  # and their number


def byte_letters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: visible ones stand for themselves."""
    seen = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bytes:
    """A byte-level tokenizer. Where its merges come in the order of their ids, ids are ranks, and the ranks alone
    decide: then a faster library encodes, which spells every text. Otherwise its own library does."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core already
        import tiktoken
        from tokenizers import Tokenizer

        letters, self.ranked = byte_letters(), None
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        entries, special = self.tokenizer.get_vocab(), self.tokenizer.get_added_tokens_decoder()
        self.spelled = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.spelled[i] = entry.encode() if i in special else bytes(letters[c] for c in entry)
        model = json.loads(self.tokenizer.to_str())
        merges = [entries["".join(m if isinstance(m, list) else m.split(" "))] for m in model["model"]["merges"]]
        before = model["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and not before["add_prefix_space"] and not model["normalizer"]
        if plain and merges == sorted(merges):
            ranks = {x: i for i, x in enumerate(self.spelled) if i not in special}
            self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str, whole: bytes) -> list[int] | None:
        """The ids of a text; none where they do not spell it."""
        if self.ranked:
            return self.ranked.encode_ordinary(text)
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return ids if b"".join(map(self.spelled.__getitem__, ids)) == whole else None


class Cutter:
    """Texts to the token ids of both tokenizers and the ends of their tokens in bytes."""

    def __init__(self, s: Settings):
        from sentencepiece import SentencePieceProcessor

        self.a = Bytes(s.first)
        self.a_bytes = self.a.spelled
        self.b = SentencePieceProcessor(model_file=s.second)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        # Decimal ids with each sign that may follow them, for the digests.
        names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.width = len(names)
        self.names = [n + sign for sign in ",|;" for n in names] + names

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[1:-1], 16)])
        return self.b.id_to_piece(i).replace("▁", " ").encode()

    def ids(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both, none where tokens do not spell the text."""
        if not text:
            return [], []
        whole = (" " + text).encode()
        a = self.a.encode(" " + text, whole)
        b = self.b.encode(text)
        if a is None or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return [], []
        return a, b

    def digest(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> str:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3``: groups in order, ids of both in each."""
        if not len(a):
            return ""
        last_a = np.append(a_group[1:] != a_group[:-1], True)
        last_b = np.append(b_group[1:] != b_group[:-1], True)
        signs = np.empty(len(a) + len(b), dtype=np.int64)
        # An id of the first stands behind all ids of the second in earlier groups, and so on.
        signs[np.arange(len(a)) + np.searchsorted(b_group, a_group, "left")] = a + self.width * last_a
        signs[np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")] = b + 2 * self.width * last_b
        signs[-1] = b[-1] + 3 * self.width
        return hashlib.sha256("".join(map(self.names.__getitem__, signs.tolist())).encode()).hexdigest()


_CUTTERS: dict[Settings, Cutter] = {}


def cutter(s: Settings) -> Cutter:
    """The cutter of this worker process, which outlives a task."""
    if s not in _CUTTERS:
        _CUTTERS[s] = Cutter(s)
    return _CUTTERS[s]


def links(cut: Cutter, texts: list) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Per text (n_a, n_b, n_groups, n_links, digest), and of all links the pair of ids and the text.

    The ends of the tokens of both, united, cut the bytes into stretches: each is the overlap of one linked pair.
    """
    rows, pairs, owners = [], [], []
    for k, text in enumerate(texts):
        a, b = (np.array(ids, dtype=np.int64) for ids in cut.ids(text))
        a_ends, b_ends = np.cumsum(cut.a_sizes[a]), np.cumsum(cut.b_sizes[b])
        ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
        twice = ends[1:] == ends[:-1]
        common, ends = ends[1:][twice], ends[np.append(True, ~twice)[: len(ends)]]
        pair = (b[np.searchsorted(b_ends, ends)] << 32) | a[np.searchsorted(a_ends, ends)]
        digest = cut.digest(a, b, np.searchsorted(common, a_ends), np.searchsorted(common, b_ends))
        rows.append((len(a), len(b), len(common), len(ends), digest))
        pairs.append(pair)
        owners.append(np.full(len(pair), k, dtype=np.int64))
    return rows, np.concatenate([np.empty(0, np.int64), *pairs]), np.concatenate([np.empty(0, np.int64), *owners])


#: The arrays of a run, in order: pairs, links of each, documents of each; then document and times of each record.
def pack(pairs: np.ndarray, owners: np.ndarray, times: np.ndarray) -> bytes:
    """A run of records sorted by pair and document."""
    starts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.empty(0, np.int64)
    documents = np.diff(np.append(starts, len(pairs)))
    arrays = [np.diff(pairs[starts], prepend=0), np.add.reduceat(times, starts), documents, owners, times]
    head = np.array([len(starts), len(pairs)], dtype="<u4").tobytes()
    body = arrays[0].astype("<i8").tobytes() + b"".join(x.astype("<u4").tobytes() for x in arrays[1:])
    return zstandard.ZstdCompressor(level=1).compress(head + body)


class Run:
    """A run read back; ``groups`` are the ranges of pairs that share their second id."""

    def __init__(self, data: bytes):
        data = zstandard.ZstdDecompressor().decompress(data)
        n, m = np.frombuffer(data, "<u4", 2)
        n, m = int(n), int(m)
        self.pairs = np.cumsum(np.frombuffer(data, "<i8", n, 8))
        self.links = np.frombuffer(data, "<u4", n, 8 + 8 * n)
        documents = np.frombuffer(data, "<u4", n, 8 + 12 * n)
        self.owners = np.frombuffer(data, "<u4", m, 8 + 16 * n)
        self.times = np.frombuffer(data, "<u4", m, 8 + 16 * n + 4 * m)
        self.records = np.concatenate([[0], np.cumsum(documents, dtype=np.int64)])

    def groups(self, number: int) -> Iterator[tuple[int, int, int, int]]:
        """(second id, number of this run, first pair, end) in the order of the id."""
        ids = self.pairs >> 32
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.empty(0, np.int64)
        for id_, start, end in zip(ids[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(ids)]):
            yield id_, number, start, end


def merged(runs: list[Run]) -> Iterator[tuple[int, list[tuple[Run, int, int]]]]:
    """A k-way heap merge: each second id with the ranges of pairs that hold it, in order."""
    current, ranges = None, []
    for id_, number, start, end in heapq.merge(*(r.groups(k) for k, r in enumerate(runs))):
        if id_ != current:
            if ranges:
                yield current, ranges
            current, ranges = id_, []
        ranges.append((runs[number], start, end))
    if ranges:
        yield current, ranges


def counted(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in order and the links of each, of some runs of a radix."""
    pairs, counts = [], []
    for _, ranges in merged([Run(x) for x in data]):
        found, at = np.unique(np.concatenate([r.pairs[s:e] for r, s, e in ranges]), return_inverse=True)
        pairs.append(found)
        counts.append(np.bincount(at, np.concatenate([r.links[s:e] for r, s, e in ranges]), len(found)).astype(np.int64))
    return np.concatenate([np.empty(0, np.int64), *pairs]), np.concatenate([np.empty(0, np.int64), *counts])


SPILLED = """block long, place int, id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,
    radix int, run binary"""


def _spill(s: Settings):
    names = [c.split()[0] for c in SPILLED.split(",")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut, block = cutter(s), TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, texts in _slices(batch["text"]):
                rows, pairs, owners = links(cut, texts)
                order = np.lexsort((owners, pairs))
                pairs, owners = pairs[order], owners[order]
                first = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]) | (owners[1:] != owners[:-1])))
                first = first[: len(pairs)]
                times = np.diff(np.append(first, len(pairs)))
                pairs, owners = pairs[first], owners[first]
                radix = (pairs >> 32) % s.radices
                out = [(block, k, id_, *row, None, None) for k, (id_, row) in enumerate(zip(batch["id"][at : at + len(texts)], rows))]
                for r in np.unique(radix).tolist():
                    own = radix == r
                    out.append((block, None, None, None, None, None, None, None, r, pack(pairs[own], owners[own], times[own])))
                block += 1
                yield pd.DataFrame(out, columns=names).astype({n: "Int64" for n in ("place", "n_a", "n_b", "n_groups", "n_links", "radix")})

    return each


def _slices(texts: pd.Series) -> Iterator[tuple[int, list]]:
    at = 0
    for part in in_parts(texts, 1 << 22):
        yield at, part
        at += len(part)


def _count(s: Settings):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list[bytes]] = {}

        def counts(radix: int) -> pd.DataFrame:
            pairs, links_ = counted(waiting.pop(radix))
            return pd.DataFrame({"radix": np.full(len(pairs), radix, dtype=np.int32), "pair": pairs, "links": links_})

        for batch in batches:
            for radix, run in zip(batch["radix"].tolist(), batch["run"]):
                waiting.setdefault(radix, []).append(run)
                if len(waiting[radix]) >= s.fan_in:
                    yield counts(radix)
        for radix in list(waiting):
            yield counts(radix)

    return each


def _contribute(s: Settings):
    def each(runs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        counts = counts.sort_values("pair")
        pairs, totals = counts["pair"].to_numpy(), counts["links"].to_numpy()
        out = []
        for at in range(0, len(runs), s.fan_in):
            some = runs.iloc[at : at + s.fan_in]
            opened = [Run(x) for x in some["run"]]
            sums = {id(r): np.zeros((2, int(r.owners.max()) + 1), dtype=np.int64) for r in opened}
            for second, ranges in merged(opened):
                start, end = np.searchsorted(pairs, [second << 32, (second + 1) << 32])
                own, total = pairs[start:end], totals[start:end]
                highest = total.max()
                for run, first, last in ranges:
                    count = total[np.searchsorted(own, run.pairs[first:last])]
                    records = slice(run.records[first], run.records[last])
                    count = np.repeat(count, np.diff(run.records[first : last + 1]))
                    owners, times = run.owners[records], run.times[records].astype(np.int64)
                    np.add.at(sums[id(run)][0], owners, times * (count == highest))
                    np.add.at(sums[id(run)][1], owners, times * count)
            for block, run in zip(some["block"].tolist(), opened):
                best, total = sums[id(run)]
                out.append((block, best.astype("<i8").tobytes(), total.astype("<i8").tobytes()))
        return pd.DataFrame(out, columns=["block", "best", "total"])

    return each


def _gather(parts: pd.DataFrame) -> pd.DataFrame:
    """The sums of each document of a block, over its radices."""
    rows = [tuple(np.frombuffer(x, "<i8") for x in r) for r in zip(parts["best"], parts["total"])]
    sums = np.zeros((2, max(len(best) for best, _ in rows)), dtype=np.int64)
    for best, total in rows:
        sums[0, : len(best)] += best
        sums[1, : len(total)] += total
    n = sums.shape[1]
    return pd.DataFrame(
        {"block": np.full(n, parts["block"].iloc[0]), "place": np.arange(n, dtype=np.int32), "n_best": sums[0], "count_sum": sums[1]}
    )


def pair_counts(spilled: DataFrame, s: Settings) -> DataFrame:
    """``radix, pair, links``: how many links of the corpus hold a pair of ids (second << 32 | first)."""
    runs = spilled.filter("run IS NOT NULL").select("radix", "run")
    partial = runs.mapInPandas(_count(s), "radix int, pair long, links long")
    return partial.groupBy("radix", "pair").agg(F.sum("links").alias("links"))


def aligned(docs: DataFrame, text: str = "text", id: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """``id``, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of ``docs``."""
    s = settings
    read = docs.select(column(id).cast("string").alias("id"), column(text).cast("string").alias("text"))
    spilled = stored(read.mapInPandas(_spill(s), SPILLED), "spilled")
    counts = stored(pair_counts(spilled, s), "pair-counts")
    runs = spilled.filter("run IS NOT NULL").select("block", "radix", "run")
    # A row per radix: into how many parts its runs go.
    need = F.greatest(F.sum(F.length("run")) / s.part, F.count("*") / s.part_runs)
    parts = runs.groupBy("radix").agg(F.ceil(need).cast("int").alias("parts"))
    runs = runs.join(parts, "radix").withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int"))
    held = counts.join(parts, "radix").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    shares = runs.select("radix", "part", "block", "run").groupBy("radix", "part").cogroup(
        held.select("radix", "part", "pair", "links").groupBy("radix", "part")
    )
    shares = shares.applyInPandas(_only_with_runs(_contribute(s)), "block long, best binary, total binary")
    sums = shares.groupBy("block").applyInPandas(_gather, "block long, place int, n_best long, count_sum long")
    kind = docs.schema[id].dataType
    rows = spilled.filter("place IS NOT NULL").join(sums, ["block", "place"], "left")
    none = F.lit(0).cast("long")
    return rows.select(
        column("id").cast(kind).alias(id),
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"),
        "groups_sha256",
    )


def _only_with_runs(f):
    """A part may have counts and no run."""

    def each(runs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        return f(runs, counts) if len(runs) else pd.DataFrame({"block": [], "best": [], "total": []}).astype({"block": "int64"})

    return each
