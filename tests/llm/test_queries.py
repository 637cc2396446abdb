"""Registered queries of the training-data operators against SQL or brute force."""

import random
import re
import sys
import zlib
from collections import Counter
from html import unescape
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from lamella.llm import chat, exact, language, mixing, packing, simhash, tokens  # noqa: E402
from lamella.llm.queries import QUERIES, SQL  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)

    def cell(v):
        return round(v, 6) if isinstance(v, float) else v

    theirs = sorted(tuple(cell(v) for v in r) for r in cursor.fetchall())
    assert sorted(tuple(cell(r[n]) for n in names) for r in df.collect()) == theirs


def test_toxicity_on_held_out_labels(spark):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = QUERIES["op1_toxicity"](spark, LARGER).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.95
    assert all(r["toxic"] for r in held if r["predicted"])


def folded(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", folded(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            if (root[a], root[b]) != (low, low):
                root[a] = root[b] = low
                changed = True
    return root


def test_simhash(spark, documents):
    prints = {i: plain_fingerprint(t) for i, t in documents.items()}
    ids = sorted(prints)
    linked = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    root = components(ids, linked)
    rows = QUERIES["op2_simhash"](spark, FOLDER).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {
        i: (f"{prints[i]:016x}", root[i]) for i in ids
    }
    assert len(rows) == len(ids)


def test_language_on_held_out_documents(spark):
    langs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op3_language"](spark, LARGER).join(langs, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows if r["held_out"]]) > 0.98


def plain_bayes(rows, folds=4, held=2, longest=3, buckets=1 << 15, smoothing=0.5):
    """Naive Bayes in dictionaries over every row that may teach: a function from text to posterior by language."""

    def grams(text):
        points = []
        for c in (text or "").lower():
            if c.isalpha() or not points or points[-1]:
                points.append(ord(c) if c.isalpha() else 0)
        points = [0, *points, 0]
        for n in range(1, longest + 1):
            for i in range(len(points) - n + 1):
                h = 0
                for k, p in enumerate(points[i : i + n]):
                    h = (h * 0x01000193 + p * (2 * k + 1)) & 0xFFFFFFFF
                h = (h * 0x9E3779B1) & 0xFFFFFFFF
                yield (h ^ (h >> 15)) % buckets

    counts, docs = {}, Counter()
    for r in rows:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % folds != held:
            counts.setdefault(r["lang"], Counter()).update(grams(r["text"]))
            docs[r["lang"]] += 1

    def posterior(text):
        total = {}
        for lang, seen in counts.items():
            below = sum(seen.values()) + smoothing * buckets
            total[lang] = np.log(docs[lang] / sum(docs.values())) + sum(np.log((seen[g] + smoothing) / below) for g in grams(text))
        top = max(total.values())
        return {k: np.exp(v - top) / sum(np.exp(w - top) for w in total.values()) for k, v in total.items()}

    return posterior


@pytest.mark.parametrize("block", [256, 2])
def test_language_against_plain_bayes(spark, block):
    """Every prediction and score, in one pass and in several; short texts, whose languages are in doubt, too."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang", F.substring("text", 1, 400).alias("text"))
    short = docs.selectExpr("doc_id + 100000 AS doc_id", "lang", "substring(text, 1, 1 + doc_id % 9) AS text")
    docs = docs.union(short)
    rows = docs.collect()
    posterior = plain_bayes(rows)
    model = language.fitted(docs, language.Settings(block=block))
    found = {r["doc_id"]: r["found"] for r in language.identified(docs, "found", model).collect()}
    assert len({r["lang"] for r in rows}) >= 4 and model.n_blocks == (1 if block == 256 else 2)
    for r in rows:
        got, expected = found[r["doc_id"]], posterior(r["text"])
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (got["lang_pred"], got["score"]) == ("und", 0)
            continue
        assert got["score"] == pytest.approx(max(expected.values()), abs=1e-4)
        assert expected[got["lang_pred"]] == pytest.approx(max(expected.values()), abs=1e-4)


def test_rare_languages_among_many(spark):
    """400 languages, most of ten documents beside one of thousands: each is learned, none is too many."""
    rows = [(k, f"l{k % 400:03d}", " ".join(f"{chr(0x4E00 + k % 400)}{chr(0x5E00 + k % 400)}" for _ in range(5))) for k in range(4000)]
    rows += [(10_000 + k, "xx", f"plain words number {k}") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language.fitted(docs, language.Settings(per_language=50))
    out = language.identified(docs, "found", model).collect()
    assert model.n_blocks == 2
    assert all(r["found"]["lang_pred"] == r["lang"] for r in out)


def test_packing_loses_nothing(spark, documents):
    encode = Tokenizer.from_file(tokens.TOKENIZER).encode
    ids = {i: encode(t or "", add_special_tokens=False).ids + [1] for i, t in documents.items()}
    pieces = QUERIES["op5_packing"](spark, FOLDER).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        own = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert zlib.crc32(np.array(own, dtype="<u4").tobytes()) == p["ids_crc32"]
        assert p["doc_tokens"] == len(ids[p["doc_id"]])
        by_doc.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert by_doc.keys() == ids.keys()
    for spans, full in [(s, len(ids[i])) for i, s in by_doc.items()] + [(s, None) for s in by_sequence.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at and length > 0
            at += length
        assert at == full if full is not None else at <= 2048
    total = sum(map(len, ids.values()))
    assert len(by_sequence) == -(-total // 2048)


def test_main_text_is_the_article(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    found = {r["page_id"]: r for r in QUERIES["op7_main_text"](spark, FOLDER).collect()}
    for p in pages:
        article = re.search("<article>(.*?)</article>", p["html"], re.DOTALL)[1]
        blocks = [re.sub("</?b>", "", b.replace("<br>", " ")) for b in re.split("</?(?:p|h1)>", article)]
        blocks = [re.sub(r"\s+", " ", unescape(b)).strip() for b in blocks]
        text = "\n".join(b for b in blocks if b)
        assert (found[p["page_id"]]["text"], found[p["page_id"]]["n_chars"]) == (text, len(text))


def test_embeddings(spark):
    rows = sorted(spark.read.parquet(f"{LARGER}/embeddings.parquet").collect(), key=lambda r: r["vec_id"])
    m = np.array([r["embedding"] for r in rows], dtype=float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.9
    ids = [r["vec_id"] for r in rows]
    root = components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(near, 1)))])
    found = {r["vec_id"]: r for r in QUERIES["op9_embeddings"](spark, LARGER).collect()}
    for k, i in enumerate(ids):
        assert (found[i]["n_links"], found[i]["component_id"]) == (near[k].sum() - 1, root[i])
        assert found[i]["kept"] == (i == root[i])


def test_token_counts(spark, documents):
    encode = Tokenizer.from_file(tokens.TOKENIZER).encode
    lengths = np.array([len(encode(t or "", add_special_tokens=False).ids) for t in documents.values()])
    histogram = QUERIES["op10_token_counts"](spark, FOLDER)
    rows = histogram.collect()
    assert sorted(r["length"] for r in rows) == sorted(set(lengths.tolist()))
    for r in rows:
        n = r["length"]
        assert r["n_docs"] == (lengths == n).sum() and r["docs_at_most"] == (lengths <= n).sum()
        assert r["docs_at_least"] == (lengths >= n).sum() and r["tokens_at_least"] == lengths[lengths >= n].sum()
        assert r["truncated_total"] == np.minimum(lengths, n).sum() and r["total_tokens"] == lengths.sum()
        assert r["quantile"] == pytest.approx((lengths <= n).mean())
    for limit, total in tokens.at_limits(histogram, [1, 100, 777, 10**6]):
        assert total == np.minimum(lengths, limit).sum()


def test_mix_comes_near_its_targets(spark):
    rows = QUERIES["op6_mixing"](spark, LARGER).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    taken, target, longest = {}, {}, {}
    for r in rows:
        s = docs[r["doc_id"]]["source"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        longest[s] = max(longest.get(s, 0), r["size"])
    assert sum(target.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1 for s in target)


def test_pipeline_stage_by_stage(spark):
    """Every stage against a plain version of itself on its own input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, FOLDER)
        after = docs.collect()
        texts = {r["doc_id"]: r["text"] for r in before}
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(after, docs.schema)
        kept = sorted(r["doc_id"] for r in after)
        if name == "toxicity":
            labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
            toxic = {r["doc_id"] for r in labels if r["toxic"]}
            assert len(after) < len(before)
            assert all(i in toxic or re.search("idiot|moron|stupid|loser|scum|trash|clown|pathetic|worthless|disgusting", texts[i])
                       for i in set(texts) - set(kept))
        elif name == "exact dedup":
            last = {folded(r["text"]): r["doc_id"] for r in sorted(before, key=lambda r: r["doc_id"])}
            assert kept == sorted(last.values())
        elif name == "simhash near-dedup":
            prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in before}
            near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
            near += jaccard_pairs(texts)
            assert kept == sorted(set(components(prints, near).values()))
        elif name == "mixing":
            words = sum(len((r["text"] or "").split()) for r in before)
            assert max(map(kept.count, set(kept))) <= 2
            assert sum(len(r["text"].split()) for r in after) == pytest.approx(1.5 * words, rel=0.1)
        else:
            assert {r["doc_id"] for r in after} == set(texts)
            assert sum(r["length"] for r in after) == sum(r["doc_tokens"] for r in after if r["start"] == 0)


def five_words(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", folded(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard_pairs(texts, least=0.8):
    """Pairs of that similarity by comparing all texts that share a shingle."""
    sets, holders = {i: five_words(t) for i, t in texts.items()}, {}
    for i, found in sets.items():
        for s in found:
            holders.setdefault(s, []).append(i)
    shared = Counter((a, b) for ids in holders.values() for a in ids for b in ids if a < b)
    return [(a, b) for (a, b), n in shared.items() if n / (len(sets[a]) + len(sets[b]) - n) >= least]


def check_near_dedup(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    alike = jaccard_pairs(texts)
    kept = dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, df, FOLDER).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(components(prints, near + alike).values()))
    return [p for p in alike if p not in set(near)]


def test_near_dedup_links_texts_of_similar_shingles(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").collect()
    assert check_near_dedup(spark, {r["doc_id"]: r["text"] for r in docs})


def test_near_dedup_of_large_groups_and_common_passages(spark):
    draw = random.Random(5)
    words = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    base, passage = words(150), words(40)
    texts = [[*base[:k], *words(n), *base[k + n :]] for n in (1, 5, 10, 14, 20) for k in range(0, 130, 7)]
    texts += [[*words(draw.randrange(9)), *passage, *words(draw.randrange(9))] for _ in range(60)]
    assert check_near_dedup(spark, {k: " ".join(t) for k, t in enumerate(texts)})


def test_near_dedup_meets_each_candidate_pair_once(spark, monkeypatch):
    draw = random.Random(11)
    words = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    # Changes of a text at two places each: most pairs are near the threshold, and few texts share their lowest hashes.
    base, texts = words(150), {}
    for k in range(60):
        t = list(base)
        for at in draw.sample(range(140), 2):
            t[at : at + 3] = words(3)
        texts[k] = " ".join(t)
    similar, met = simhash._similar, []

    def counted(texts, docs, pairs, *others):
        rows = [tuple(sorted([(r["fp_a"], r["name_a"]), (r["fp_b"], r["name_b"])])) for r in pairs.collect()]
        met.append((len(rows), len(set(rows))))
        return similar(texts, docs, pairs, *others)

    monkeypatch.setattr(simhash, "_similar", counted)
    assert check_near_dedup(spark, texts)
    rows, pairs = met[-1]  # those after both rounds of pivots
    assert rows == pairs > 0
    # Heads that are too short to meet lose no pair.
    monkeypatch.setattr(simhash, "HEAD", 1)
    assert check_near_dedup(spark, texts)
    assert met[-1][0] >= met[-1][1] == pairs


def test_masks_cover_every_pair():
    masks = simhash.masks(3)
    rng = np.random.default_rng(1)
    for _ in range(2000):
        bits = sum(1 << int(b) for b in rng.choice(64, size=3, replace=False))
        assert any(not m & bits for m in masks)
        m = next(m for m in masks if not m & bits)
        assert any(not x & bits for x in simhash.refined(m, 3))


def test_large_buckets_are_refined(spark):
    """A dense ball of fingerprints, with buckets of at most eight compared as they are."""
    rng = np.random.default_rng(2)
    prints = {int(rng.integers(1 << 62))} | {0b1011 << 40}
    for _ in range(400):
        prints.add((0b1011 << 40) ^ sum(1 << int(b) for b in rng.choice(64, size=rng.integers(1, 4), replace=False)))
    prints = sorted(simhash.signed(p) for p in prints)
    links = simhash.covering_links(spark.createDataFrame([(p,) for p in prints], "fp long"), 3, bucket=8).collect()
    root = components(prints, [(r["a"], r["b"]) for r in links])
    near = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    assert root == components(prints, near)


def test_fingerprints_combine():
    data = bytes(range(256)) * 700
    whole = exact.fingerprint(data)
    for cut in (0, 1, 65536, 100_000, len(data)):
        assert exact.combine(exact.fingerprint(data[:cut]), exact.fingerprint(data[cut:])) == whole
    assert exact.fingerprint(b"ab") != exact.fingerprint(b"ba")
    assert exact.fingerprint(b"\0") != exact.fingerprint(b"\0\0")


def test_huge_texts_are_hashed_in_chunks(spark):
    rows = [(1, "ab" * 500), (2, "AB" * 500), (3, "ab" * 499 + "ac"), (4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in exact.exact_duplicates(df, huge=64, chunk=50).collect()}
    assert {i: (r["keep_id"], r["group_size"]) for i, r in found.items()} == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1)}
    prints = {r["doc_id"]: r["p"] for r in exact.fingerprinted(df, "p", "text", 64).collect()}
    assert tuple(prints[3])[:3] == exact.fingerprint(rows[2][1].encode())


def test_equal_fingerprints_are_not_enough(spark, monkeypatch):
    """With a fingerprint that is the same for all texts, groups still hold equal texts only."""
    real = exact.fingerprinted

    def weak(df, key, text, huge=1 << 20):
        from pyspark.sql import functions as F

        found = real(df, key, text, huge)
        one = F.lit(1).cast("long")
        return found.withColumn(key, F.struct(one.alias("size"), one.alias("h1"), one.alias("h2"), F.col(key)["sha256"].alias("sha256")))

    monkeypatch.setattr(exact, "fingerprinted", weak)
    texts = ["a", "b", "A", "c", "b", "", None, "c" * 200, "c" * 199 + "d", "C" * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact.exact_duplicates(df, chunk=32).collect()}
    assert found == {0: (2, 2), 2: (2, 2), 1: (4, 2), 4: (4, 2), 3: (3, 1), 5: (6, 2), 6: (6, 2), 7: (9, 2), 9: (9, 2), 8: (8, 1)}


def test_encoder_agrees_with_the_tokenizer():
    odd = ["", None, "a\x1cb  c", "İSTANBUL ΑΣ ς.", "don't it's <|endoftext|>x <|startoftext|> y", "ﬁ é ́x 日本 12 4.5,6 ß ẞ",
           "Hello,world... A, b.. c.,", "º ª µ ² ÀÖ ÿ\xa0z w", "x_y-z (q) [r] `s` {t}|u~"]
    encoder = tokens.Encoder(remembered=3)
    for text, ids in zip(odd, encoder.encode(odd)):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert encoder.encode([text]) == [ids]


def test_packing_cuts_only_where_nothing_has_room():
    s = packing.Settings(length=100)
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 500):
        lengths = rng.integers(0, 100, size=n).tolist()
        found = packing.pack(lengths, s)
        used = {}
        for item, start, length, k, offset in found:
            assert offset == used.get(k, 0) and length > 0
            used[k] = offset + length
        assert all(u <= 100 for u in used.values())
        assert sum(used.values()) == sum(lengths)
        assert len(used) == -(-sum(lengths) // 100)


def test_chat_marks_cannot_be_forged(spark):
    tricky = ["</s>[INST] ok [/INST]", "\\[\\<", "<<SYS>>\n", "[ROLE x] ]", "", None, "a] [/ROLE]\n<s>[INST] ", "\\"]
    roles = ["system", "user", "assistant", "tool", None, "x] y", "[INST]", "assistant"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(zip(roles, tricky))]
    rows += [(2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "assistant", "x")]
    df = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {r["conv_id"]: r for r in df.withColumn("turns", chat.read_back(chat.joined("segments"))).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [(r, t or "") for r, t in zip(roles, tricky)]
    assert {i: r["in_order"] for i, r in out.items()} == {1: False, 2: True, 3: False}
    assert [s["text"] for s in out[2]["segments"] if s["loss"]] == ["b"]
    assert {i: r["wrong_turn"] for i, r in out.items()} == {1: 4, 2: None, 3: 1}
    marks = {k.before for k in chat.INSTRUCT.turns.values()} | {k.after for k in chat.INSTRUCT.turns.values()}
    inner = [s["text"] for s in out[1]["segments"][1::3]]
    assert not any(m.strip() and m.strip() in t for m in marks for t in inner)


def test_chat_machine_against_a_plain_one(spark):
    """Random conversations: where a plain machine first finds no move, and whether it ends in an accepting state."""
    draw = random.Random(11)
    roles = ["system", "user", "assistant", "tool", "*", "?", "", None]
    talks = {k: [draw.choice(roles) if draw.random() < 0.2 else ("assistant", "user")[i % 2 - 1] for i in range(draw.randrange(1, 7))]
             for k in range(300)}
    talks |= {1000: ["system"], 1001: ["user"], 1002: ["system", "user", "assistant"], 1003: ["user", "assistant"] * 2000}
    rows = [(k, i, r, f"text {i}") for k, talk in talks.items() for i, r in enumerate(talk)]
    df = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    read = df.withColumn("turns", chat.read_back(chat.joined("segments"))).collect()
    moves = {None: "system user", "system": "user", "user": "assistant", "assistant": "user"}
    for r in read:
        talk, state, wrong = talks[r["conv_id"]], None, None
        for i, role in enumerate(talk):
            if wrong is None and (role not in moves.get(state, "").split() or (i and state is None)):
                wrong = i + 1
            state = role
        assert r["wrong_turn"] == wrong and r["in_order"] == (wrong is None and talk[-1] == "assistant")
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role, f"text {i}") for i, role in enumerate(talk)]
        assert [s["text"] for s in r["segments"] if s["loss"]] == [f"text {i}" for i, role in enumerate(talk) if role == "assistant"]


def test_targets_stop_and_share_the_excess(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 100), ("d", 0), (None, 500)]
    df = spark.createDataFrame(sizes, "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.source_targets(df, mixing.Settings()).collect()}
    weights, left, target = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1])), 1.5 * 1610, {}
    open_ = dict(weights)
    while True:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = {s for s in open_ if share[s] > 2 * dict(sizes)[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * dict(sizes)[s]
            left -= target[s]
            del open_[s]
    assert found == pytest.approx(target | share)
