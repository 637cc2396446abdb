"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for operators and stages."""

import math
import random
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from lamella.llm import chat, embeddings, exact, language, mixing, packing, pages, simhash, tokens, toxicity  # noqa: E402
from lamella.llm.common import connected_components  # noqa: E402

LONG = "word " * 60_000 + "end"
ROWS = [
    (1, "One two three four five.", "en", "a"),
    (1, "One two three four five.", "en", "a"),  # a repeated row
    (2, "one TWO three four five.", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (None, "lost and found again here", "en", None),
    (None, "lost and found again here", "en", None),
    (None, "something else without an id", None, "b"),
    (5, LONG, "en", "b"),
    (6, "éß 日本 12", "fr", "c"),
    (7, " \t\n ", "en", "c"),
]
#: Names that the operators use themselves.
CLASHES = "id fp print kept_id kept_fp kept_sha256 copies row toxicity size key tie coarse fine plan_source n text_name score".split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(c) for c in CLASHES})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def found(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_exact(docs, empty):
    result = exact.exact_duplicates(docs)
    assert result.count() == len(ROWS)
    kept = [r for r in result.collect() if r["kept"]]
    assert len(kept) == 7  # 2; 4 of the empty ones; the two texts without id; 5; 6; 7
    assert {r["keep_id"] for r in kept} == {2, 4, 5, 6, 7, None}
    sizes = {r["doc_id"]: r["group_size"] for r in result.collect() if r["doc_id"]}
    assert sizes == {1: 3, 2: 3, 3: 2, 4: 2, 5: 1, 6: 1, 7: 1}
    rows = exact.drop_exact_duplicates(docs)
    assert rows.columns == docs.columns and rows.count() == 7
    assert exact.exact_duplicates(empty).count() == 0 and exact.drop_exact_duplicates(empty).count() == 0


def test_simhash(docs, empty):
    result = simhash.simhash_duplicates(docs)
    assert result.count() == len(ROWS)
    by_id = {r["doc_id"]: r for r in result.collect() if r["doc_id"]}
    assert by_id[3]["fingerprint"] == by_id[4]["fingerprint"] == by_id[7]["fingerprint"] == "0" * 16
    assert {by_id[i]["component_id"] for i in (3, 4, 7)} == {3} and by_id[2]["component_id"] == 1
    rows = simhash.drop_near_duplicates(docs)
    assert rows.columns == docs.columns
    assert found(rows, "doc_id", "text") == sorted(
        {(r[0], r[1]) for r in ROWS if r[0] in (1, 3, 5, 6, None)}, key=repr
    )
    assert simhash.simhash_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0
    assert simhash.fingerprint("a b") == simhash.fingerprint(" A\tb ") != 0


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 1), (3, 0, None), (2, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        model = toxicity.fitted(docs, known)
        scores = toxicity.scored(docs, "fresh", model)
        assert scores.count() == len(ROWS) and scores.filter("fresh IS NULL OR fresh < 0 OR fresh > 1").isEmpty()
        assert len({r["fresh"] for r in scores.filter("text IS NULL OR trim(text) = ''").collect()}) == 1
    assert toxicity.scored(empty, "fresh", model).count() == 0


@pytest.mark.parametrize(
    "low, high",
    [
        ("you are not an idiot", "you are an idiot"),
        ('he said "you are an idiot"', "you are an idiot"),
        ("such an idiot", "you are such an idiot"),
        ("kill the lights", "i will kill you"),
        ("i never kill you", "kill you"),
        ("the idiot's guide, by him", "the idiot, the moron, the clown"),
    ],
)
def test_toxic_grammar_weighs_clauses(low, high):
    reader = toxicity.Reader(toxicity.Model({}, 0.0, 1.0, toxicity.Settings()))
    assert reader.value(low) < reader.value(high)
    assert reader.value("a clean text. nothing here") == 0


def test_which_row_of_one_id_and_text_stays(spark):
    rows = [(1, "same text here", f"source {k % 5}", None if k % 2 else k) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    for operator in (exact.drop_exact_duplicates, simhash.drop_near_duplicates):
        kept = {tuple(operator(df.repartition(n)).collect()) for n in (1, 3, 8)}
        assert len(kept) == 1 and len(next(iter(kept))) == 1


def cascade(text, model):
    """The value of a text by running the four transducers one after the other over each clause."""
    reader, total = toxicity.Reader(model), 0.0
    parts = [toxicity.negation(), toxicity.reported(), toxicity.threat(), toxicity.target()]
    scoring = {toxicity.INSULT, toxicity.AIMED, toxicity.NOT_INSULT, toxicity.SAID_INSULT, toxicity.CARRIED_OUT}
    clause = []
    for word in [*toxicity.WORDS.findall((text or "").lower()), "."]:
        found = reader.look_up(word)
        if found != -1:
            clause.append(found or (toxicity.OTHER, 0.0))
            continue
        tape = clause
        for part in parts:
            state, written = 0, []
            for symbol, weight in tape:
                state, symbol, factor, constant = part.step(state, symbol)
                written.append((symbol, factor * weight + constant))
            tape = written
        total += max(sum(w for symbol, w in tape if symbol in scoring), 0.0) ** model.settings.power
        clause = []
    return total ** (1 / model.settings.power)


def test_composed_machine_equals_the_cascade(spark):
    draw = random.Random(3)
    model = toxicity.Model({"grub": 4.0, "snar*": 3.5}, -5.0, 2.0, toxicity.Settings())
    classes = [toxicity.INSULTS, toxicity.THREATS, toxicity.TARGETS, toxicity.MODALS, toxicity.NEGATIONS, toxicity.REPORTS]
    words = [w for c in classes for w in c[:3]] + ["grub", "snarling", "snar", "house", "and", ".", ",", "\"", "\n"]
    texts = [" ".join(draw.choices(words, k=draw.randrange(40))) for _ in range(400)] + [None, "", "you idiot " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["s"] for r in toxicity.scored(df, "s", model).collect()}
    for i, text in enumerate(texts):
        odds = -5.0 + 2.0 * cascade(text, model)
        odds = odds if odds <= 15 else 15 + 15 * (1 - math.exp((15 - odds) / 15))
        assert rows[i] == pytest.approx(1 / (1 + math.exp(-odds)), rel=1e-9)
    assert any(r > 0.5 for r in rows.values()) and any(0 < r < 0.5 for r in rows.values())


def test_scores_of_very_toxic_texts_differ(spark):
    model = toxicity.Model({}, -5.0, 2.0, toxicity.Settings())
    df = spark.createDataFrame([(n, "you idiot. " * n) for n in range(1, 40)], "doc_id long, text string")
    scores = [r["s"] for r in toxicity.scored(df, "s", model).orderBy("doc_id").collect()]
    assert all(a < b < 1 for a, b in zip(scores, scores[1:]))


def test_which_copies_teach_does_not_depend_on_their_order(spark):
    base = "one two three four five six seven eight nine ten eleven twelve".split()
    rows = [(" ".join([*base, f"end{k % 9}"]), k % 2) for k in range(60)] + [(f"text number {k} alone", 0) for k in range(20)]
    df = spark.createDataFrame(rows, "text string, toxic int")
    kept = [sorted(map(tuple, toxicity.without_copies(df.repartition(n)).collect())) for n in (1, 3, 8)]
    assert kept[0] == kept[1] == kept[2] and {t for x, t in kept[0] if x.startswith("one")} == {0, 1}
    assert sum(x.startswith("text") for x, _ in kept[0]) >= 15


def test_language(docs, empty):
    model = language.fitted(docs)
    rows = {r["doc_id"]: r["found"] for r in language.identified(docs, "found", model).collect()}
    assert rows[3]["lang_pred"] == rows[4]["lang_pred"] == rows[7]["lang_pred"] == "und"
    assert rows[3]["score"] == 0 and rows[5]["lang_pred"] in ("en", "fr")
    nothing = language.fitted(empty)
    assert {r["found"]["lang_pred"] for r in language.identified(docs, "found", nothing).collect()} == {"und"}
    assert language.identified(empty, "found", model).count() == 0


def test_packing_and_counts(docs, empty):
    pieces = packing.packed(docs).collect()
    whole = [p for p in pieces if p["start"] == 0]
    assert len(whole) == len(ROWS)
    assert sum(p["length"] for p in pieces) == sum(p["doc_tokens"] for p in whole)
    assert [p["doc_tokens"] for p in whole if p["doc_id"] in (3, 4, 7)] == [1, 1, 1]
    assert [p["doc_tokens"] for p in whole if p["doc_id"] == 5] == [60_002]
    assert packing.packed(empty).count() == 0
    lengths = {r["length"]: r["n_docs"] for r in tokens.length_histogram(docs).collect()}
    assert lengths[0] == 3 and lengths[60_001] == 1 and sum(lengths.values()) == len(ROWS)
    assert tokens.length_histogram(empty).count() == 0
    assert tokens.at_limits(tokens.length_histogram(empty), [5]) == [(5, 0)]


def test_mixing(docs, empty):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert found(mixing.mixed(docs), "doc_id", "taken") == found(mixing.mixed(docs.repartition(5)), "doc_id", "taken")
    mix = mixing.mixture(docs)
    assert mix.columns == docs.columns
    words = sum(len((r["text"] or "").split()) for r in mix.collect())
    assert words == sum(r["taken"] for r in rows)
    assert mixing.mixed(empty).count() == 0 and mixing.mixture(empty).count() == 0


@pytest.mark.parametrize("ids", ["cast(null as long)", "7L", "id"])
def test_mixing_takes_a_part_of_equal_rows(spark, ids):
    """All rows tie, by their text, by id and text, or not at all: the words taken come as near as rows allow."""
    docs = spark.range(0, 300, 1, 7).selectExpr(f"{ids} AS doc_id", "id % 2 AS source", "repeat('word ', 4) AS text", "id AS n_chars")
    rows = mixing.mixed(docs).collect()
    target = {r["target"] for r in rows}
    assert len(rows) == 300 and target == {1200.0, 600.0}
    for t in target:
        assert sum(r["taken"] for r in rows if r["target"] == t) == t
    s = mixing.Settings(share=0.375)
    rows = mixing.mixed(docs, s=s).collect()
    for t in {r["target"] for r in rows}:
        assert abs(sum(r["taken"] for r in rows if r["target"] == t) - t) <= 2
    mix = mixing.mixture(docs, s=s).collect()
    assert 4 * len(mix) == sum(r["taken"] for r in rows) and len({r["n_chars"] for r in mix}) == len(mix)


def test_mixing_orders_texts_of_one_id(spark):
    rows = [(1, "s", " ".join("w" * n)) for n in range(1, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    results = [mixing.mixed(docs.repartition(n), s=mixing.Settings(share=0.4)).collect() for n in (1, 6)]
    one, other = (sorted((r["size"], r["taken"]) for r in rows) for rows in results)
    assert one == other and abs(sum(t for _, t in one) - 0.4 * sum(range(1, 40))) <= 20


def test_pages(spark):
    nav = "<nav><a href='/x'>Menu</a></nav>"
    rows = [
        (1, "http://h/1", f"<body>{nav}<article><header>Top</header><p>A &amp;amp; b&nbsp; c<p>d<br>e</article><footer>f</footer>"),
        (2, None, None),
        (3, "", ""),
        (None, "http://h/1", "<p>plain <b>bold</p>tail < 5 & more"),
        (4, "http://h/2", "<main><h1>T</h1><div class='cookie-notice'>ok?</div><section id=comments><p>nice</p></section>x</main>"),
        (4, "http://h/2", "<main><h1>T</h1><div class='cookie-notice'>ok?</div><section id=comments><p>nice</p></section>x</main>"),
        (5, "http://h/3", "<div " * 3 + "<article><p title='a hidden gem'>shown</p><form>no</form><script>if (a<b) '</p>'</script>y"),
        (6, "http://deep/", "<div>" * 3000 + "deep" + "</div>" * 3000),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit(2))
    result = {r["page_id"]: r for r in pages.extracted(df).collect()}
    assert pages.extracted(df).count() == len(rows)
    assert result[1]["text"] == "A &amp; b c\nd e"
    assert result[2]["text"] == result[3]["text"] == "" and result[2]["n_chars"] == 0
    assert result[None]["text"] == "plain bold\ntail < 5 & more"
    assert result[4]["text"] == "T\nx" and result[5]["text"] == "shown\ny" and result[6]["text"] == "deep"
    assert pages.extracted(df.limit(0)).count() == 0


def test_style_tree_finds_the_template_without_markup_that_says_so(spark):
    page = "<body><div class=a><span>Our shop</span></div><div class=b><p>Text {0} of its own</p></div><div class=c>Call us</div></body>"
    rows = [(k, f"http://shop.example/{k}", page.format(k)) for k in range(8)]
    rows += [(100 + k, f"http://same.example/{k}", page.format("same")) for k in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    result = {r["page_id"]: r["text"] for r in pages.extracted(df).collect()}
    assert {k: result[k] for k in range(8)} == {k: f"Text {k} of its own" for k in range(8)}
    assert result[100] == "Our shop\nText same of its own\nCall us"  # nothing varies, so nothing is removed


def test_style_tree_removes_what_a_host_repeats_inside_articles(spark):
    page = (
        "<body><article><h1>Dish {0}</h1><div class=k1><p>Share it with <b>friends</b></p></div><h2>Method</h2>"
        "<p>Stir pot {0}, <b>slowly</b>, for {0} minutes.</p><table><tr><th>Cups</th><td>{0}</td></tr></table>"
        "<ul class=k2><li>By our cooks</li></ul></article></body>"
    )
    wanted = "Dish {0}\nMethod\nStir pot {0}, slowly, for {0} minutes.\nCups\n{0}"
    rows = [(k, "http://cook.example/", page.format(k)) for k in range(8)]
    rows += [(100 + k, "http://same.example/", page.format("same") + f"<p>{k}</p>") for k in range(8)]
    # Only the titles of long articles differ.
    long = "<body><main><h1>Day {0}</h1><div class=k3><p>" + "All the rules of the house. " * 9 + "</p></div></main></body>"
    rows += [(200 + k, "http://rules.example/", long.format(k)) for k in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    result = {r["page_id"]: r["text"] for r in pages.extracted(df).collect()}
    assert {k: result[k] for k in range(8)} == {k: wanted.format(k) for k in range(8)}
    assert result[100].startswith("Dish same\nShare it with friends\nMethod") and result[100].endswith("By our cooks")
    assert result[203] == "Day 3\n" + ("All the rules of the house. " * 9).strip()


def test_copied_pages_are_no_template(spark):
    inner = "<div class=post><ul><li>One</li></ul><table><tr><td>{0}</td></tr></table><p>Two</p></div>"
    article = "<body><article>" + inner + "</article></body>"
    plain = "<body><div class=shop><span>{0}</span></div><div class=b><p>Text {0}</p></div></body>"
    rows = [(k, "http://a.example/", article.format("same")) for k in range(40)]
    rows += [(100, "http://a.example/", article.format("other")), (101, "http://a.example/", article.format("third"))]
    rows += [(200 + k, "http://b.example/", plain.format("same")) for k in range(40)]
    rows += [(300 + k, "http://b.example/", plain.format(k).replace("<p>", "<p class=x>")) for k in range(3)]
    # Other pages keep the parents of these styles alive.
    rows += [(400 + k, "http://a.example/", f"<body><article><b>Own {k}</b></article></body>") for k in range(40)]
    rows += [(500 + k, "http://b.example/", f"<body><i>Own {k}</i></body>") for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    result = {r["page_id"]: r["text"] for r in pages.extracted(df).collect()}
    assert {result[k] for k in range(40)} == {"One\nsame\nTwo"} and result[100] == "One\nother\nTwo"
    assert {result[200 + k] for k in range(40)} == {"same\nText same"}


def test_chat(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "system", None), (None, 1, None, "x"), (2, 3, "assistant", LONG), (2, 3, "assistant", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    result = {r["conv_id"]: r for r in chat.digests(chat.formatted(df)).collect()}
    assert {i: r["n_turns"] for i, r in result.items()} == {1: 3, None: 1, 2: 2}
    assert result[2]["loss_chars"] == 2 * len(LONG) and result[1]["loss_chars"] == 0
    turns = chat.formatted(df).withColumn("t", chat.read_back(chat.joined("segments"))).filter("conv_id = 1").first()["t"]
    assert [(t["role"], t["text"]) for t in turns] == [("system", ""), ("user", "a"), ("user", "b")]
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (10, [0.0, 1.0]), (None, [0.0, 1.0]), (11, [-1.0, 0.0]), (12, [1e-30, 0.0])]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("node", F.lit(1))
        result = embeddings.linked(df)
        assert result.count() == len(rows)
        by_id = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in result.collect()}
        assert by_id[1] == (3, 1, True) and by_id[2] == by_id[12] == (3, 1, False)
        assert all(by_id[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11))
        assert by_id[10] == (1, 10, True) and by_id[None] == (1, 10, False)
    assert embeddings.linked(df.limit(0)).count() == 0


def test_embeddings_of_dense_and_loose_groups(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    m = np.concatenate([c + rng.normal(size=(60, 16)) * s for c, s in zip(centres, np.linspace(0.01, 0.6, 12))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "vec_id long, embedding array<double>")
    unit = m / np.sqrt((m * m).sum(axis=1, keepdims=True))
    near = unit @ unit.T >= 0.9
    root = np.arange(len(m))
    while not (root == (new := np.array([root[x].min() for x in near]))).all():
        root = new
    for block in (4096, 100):
        rows = {r["vec_id"]: r for r in embeddings.linked(df, s=embeddings.Settings(block=block)).collect()}
        assert all((rows[k]["n_links"], rows[k]["component_id"]) == (near[k].sum() - 1, root[k]) for k in range(len(m)))


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5), (7, 6)]
    rows = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in rows} == {k: 0 for k in range(61)} | {k: 1000 for k in range(1000, 1200)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, empty, name, stage):
    folder = "/root/testdata/sf0.001"
    result = stage(spark, docs, folder)
    assert not result.isEmpty() and stage(spark, empty, folder).isEmpty()
    if name != "packing":
        assert result.columns == docs.columns
    if name == "toxicity":
        assert result.count() == len(ROWS)  # all are clean


def test_embeddings_of_loose_groups_are_dropped_without_a_look_at_each_pair(monkeypatch):
    draw, s = np.random.default_rng(7), embeddings.Settings()
    blocks, looked = [], []
    for name in (1, 2):
        centres = draw.normal(size=(40, 64)).repeat(10, axis=0)
        m = np.concatenate([draw.normal(size=(400, 64)), centres + 0.8 * draw.normal(size=(400, 64))])
        m[5::50] = m[4::50] + 0.1 * draw.normal(size=(16, 64))
        blocks.append(pd.DataFrame({"block": name, "node": np.arange(800) + 800 * name, "n": 1, "data": [v.tobytes() for v in m]}))
    blocks[1].loc[7, "data"] = blocks[0]["data"][3]
    near = embeddings.Traversal._near

    def counted(self, level, i, *others):
        looked.append(len(i))
        return near(self, level, i, *others)

    monkeypatch.setattr(embeddings.Traversal, "_near", counted)
    monkeypatch.setattr(embeddings, "STEP", 1 << 16)  # as many children to a step as blocks of the usual size have
    trees = [embeddings._blocked(s)(b) for b in blocks]
    for part in (trees, trees[:1]):
        looked.clear()
        found = embeddings._compared(s)(pd.concat(part))
        rows = pd.concat(part)
        m = embeddings.unit(rows["data"])
        linked = m @ m.T >= s.cosine
        if len(part) == 2:
            linked &= (rows["block"].to_numpy()[:, None] != rows["block"].to_numpy()[None, :])
        else:
            np.fill_diagonal(linked, False)
        want = dict(zip(rows["node"], linked.sum(axis=1)))
        assert dict(zip(found["node"], found["n"])) == {k: n for k, n in want.items() if n}
        assert len(found) and sum(looked) < 0.02 * 800 * 800
