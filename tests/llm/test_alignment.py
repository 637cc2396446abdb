"""Tokenizer alignment against a brute-force version that looks at every pair of tokens."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lamella.llm import alignment
from lamella.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
FIGURES = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def placed(ids, spelled):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(spelled[i]), i))
        at += len(spelled[i])
    return out


def brute(texts):
    cut = alignment.cutter(alignment.Settings())
    counts, each = Counter(), []
    for text in texts:
        a, b = cut.ids(text)
        a, b = placed(a, cut.a_bytes), placed(b, cut.b_bytes)
        ends = {e for _, e, _ in a} & {e for _, e, _ in b}
        linked = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        groups, start = [], 0
        for end in sorted(ends):
            sides = [",".join(str(i) for s, e, i in side if start <= s and e <= end) for side in (a, b)]
            groups.append("|".join(sides))
            start = end
        counts.update(linked)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        each.append((len(a), len(b), len(ends), linked, digest))
    highest = Counter()
    for (_, j), n in counts.items():
        highest[j] = max(highest[j], n)
    return [
        (n_a, n_b, g, len(ls), sum(counts[x] == highest[x[1]] for x in ls), sum(counts[x] for x in ls), digest)
        for n_a, n_b, g, ls, digest in each
    ]


def test_query_agrees_with_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("n_chars < 1500").select("doc_id", "text")
    ids, texts = zip(*docs.collect())
    found = {r["doc_id"]: tuple(r[n] for n in FIGURES) for r in alignment.aligned(docs).collect()}
    assert found == dict(zip(ids, brute(texts)))
    whole = QUERIES["op11_alignment"](spark, FOLDER)
    assert whole.columns == ["doc_id", *FIGURES]
    assert whole.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


TEXTS = [
    None, "", " ", "   two  blanks ", "tab\tline\n\nend", "naïve 日本語 🙂", "<s> [INST] <|endoftext|> <0x41>",
    "a▁b", "ﬁne", "plain words", "plain words", "\x00\x01", "x" * 500, "the " * 200,
]


@pytest.mark.parametrize("settings", [alignment.Settings(), alignment.Settings(radices=3, fan_in=2, part=200, part_runs=1)])
def test_edges(spark, settings):
    rows = [(k, t, "x", "y") for k, t in enumerate(TEXTS)] + [(None, "no id", "x", "y"), (0, "again", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, radix string").repartition(5)
    found = sorted(((r["doc_id"], *(r[n] for n in FIGURES)) for r in alignment.aligned(docs, settings=settings).collect()), key=repr)
    want = brute([t for _, t, *_ in rows])
    assert found == sorted(((row[0], *w) for row, w in zip(rows, want)), key=repr)
    by_id = {k: w for k, w in enumerate(want[: len(TEXTS)])}
    for k in (0, 1, 7):  # null, empty, and a character that one tokenizer takes for a blank
        assert by_id[k] == (0, 0, 0, 0, 0, 0, "")
    assert all(by_id[k][0] for k in (2, 3, 4, 5, 6, 9, 12))
    assert alignment.aligned(docs.limit(0)).count() == 0
    assert alignment.aligned(docs.filter("text IS NULL")).collect()[0]["groups_sha256"] == ""


def test_a_hot_id_is_split_over_parts(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the the the").alias("text")).repartition(12)
    settings = alignment.Settings(part_runs=2)
    rows = alignment.aligned(docs, settings=settings).collect()
    (want,) = set(brute(["the the the"] * 3000))
    assert {tuple(r[n] for n in FIGURES) for r in rows} == {want}


def test_runs_are_merged_in_order():
    pairs = [[(1 << 32) | 5, (1 << 32) | 7, (4 << 32) | 1], [(1 << 32) | 5, (2 << 32) | 9]]
    runs = []
    import numpy as np

    for some in pairs:
        p = np.array(some)
        runs.append(alignment.pack(p, np.zeros(len(p), np.int64), np.full(len(p), 2)))
    opened = [alignment.Run(r) for r in runs]
    assert [(i, len(r)) for i, r in alignment.merged(opened)] == [(1, 2), (2, 1), (4, 1)]
    found, counts = alignment.counted(runs)
    assert found.tolist() == sorted(set(pairs[0] + pairs[1])) and counts.tolist() == [4, 2, 2, 2]


def test_ids_are_those_of_the_tokenizers(spark):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    settings = alignment.Settings()
    cut = alignment.cutter(settings)
    first = Tokenizer.from_file(settings.first)
    first.encode_special_tokens = True
    second = SentencePieceProcessor(model_file=settings.second)
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()
    for text in [r["text"] for r in rows if r["text"]] + [t for t in TEXTS if t]:
        a, b = cut.ids(text)
        if a:
            assert a == first.encode(" " + text, add_special_tokens=False).ids and b == second.encode(text)
            assert b"".join(cut.a_bytes[i] for i in a) == (" " + text).encode()
