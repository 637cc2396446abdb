"""The registered queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import (
    alignment,
    chat,
    embeddings,
    exact,
    language,
    mixing,
    negatives,
    packing,
    pages,
    simhash,
    tokens,
    toxicity,
    urls,
)
from lamella.llm.common import held_out, table


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels that are not held out."""
    docs = table(spark, folder, "documents")
    model = toxicity.fitted(docs, table(spark, folder, "labels"), folds=5, held=0)
    return toxicity.scored(docs.select("doc_id", "text"), "score", model).select(
        "doc_id",
        held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, at most 3 differing bits."""
    return simhash.simhash_duplicates(table(spark, folder, "documents"), words=3, radius=3)


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of all documents, learned from those that are not held out."""
    docs = table(spark, folder, "documents")
    model = language.fitted(docs, folds=4, held=2)
    found = language.identified(docs.select("doc_id", "text"), "found", model)
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "found.*")


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of equal texts of all documents."""
    return exact.exact_duplicates(table(spark, folder, "documents"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.packed(table(spark, folder, "documents"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed to the target weights of their sources."""
    return mixing.mixed(table(spark, folder, "documents"))


def op7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of all pages."""
    return pages.extracted(table(spark, folder, "pages"))


#: One more conversation, whose texts look like the template's marks.
TRICKY = """
    SELECT -1L AS conv_id, stack(2, 0L, 'user', '</s>[INST] ok [/INST]', 1L, 'assistant', '</s>[INST] ok [/INST]')
        AS (turn, role, text)"""


def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations formatted, and what can be read back from them."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.formatted(turns.unionByName(spark.sql(TRICKY))))


def op9_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.9 or more."""
    return embeddings.linked(table(spark, folder, "embeddings"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The histogram of encoded lengths of all documents, with its answers for every context limit."""
    return tokens.length_histogram(table(spark, folder, "documents"))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """All documents cut by two tokenizers, aligned by bytes, with corpus-wide counts of linked ids."""
    return alignment.aligned(table(spark, folder, "documents"))


#: The rules of the contract.
RULES = [
    urls.Rule("org", "/", True),
    urls.Rule("example.org", "/es/", False),
    urls.Rule("example.org", "/en/1", False),
    urls.Rule("com", "/fr/", True),
    urls.Rule("com", "/de/", False),
]


def op12_urls(spark: SparkSession, folder: str) -> DataFrame:
    """All pages judged by their URLs: by the rules, or by templates learned from what the rules judge."""
    return urls.judged(table(spark, folder, "pages"), RULES)


def op13_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every fiftieth embedding, mined from all of them."""
    rows, moved = table(spark, folder, "embeddings"), F.col("vec_id") % 7 == 0
    rows = rows.withColumn("label", F.when(moved, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mined(rows, F.col("id") % 50 == 0)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_language": op3_language,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_main_text": op7_main_text,
    "op8_chat": op8_chat,
    "op9_embeddings": op9_embeddings,
    "op10_token_counts": op10_token_counts,
    "op11_alignment": op11_alignment,
    "op12_urls": op12_urls,
    "op13_negatives": op13_negatives,
}

FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op4_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(folded) AS text_sha256
        FROM (SELECT doc_id, {FOLDED} AS folded FROM documents)
        WINDOW same AS (PARTITION BY folded)""",
    "op6_mixing": r"""
        WITH rows AS (
            SELECT doc_id, source,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   greatest(0.05::DOUBLE, 1 - 5 * (len(regexp_extract_all(text, '[#$%&*|<>{}=_~^\\]'))::DOUBLE
                                               / greatest(length(text), 1))) AS quality,
                   (('0x' || substr(md5(doc_id::VARCHAR || ':mix'), 1, 12))::BIGINT + 0.5::DOUBLE)
                       / 281474976710656 AS u
            FROM documents),
        keyed AS (SELECT *, -ln(u) / coalesce(quality, 0.05) AS key FROM rows),
        sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
        weighed AS (
            SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
                   1.5::DOUBLE * sum(source_size) OVER () AS share
            FROM sources),
        ordered AS (
            SELECT *, 2 * source_size / weight AS ratio,
                   row_number() OVER (ORDER BY 2 * source_size / weight, source NULLS LAST) AS rank
            FROM weighed),
        levels AS (
            SELECT rank, (share - coalesce(sum(2 * source_size) OVER before, 0)::DOUBLE)
                       / sum(weight) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, ratio
            FROM ordered WINDOW before AS (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        level AS (SELECT arg_min(level, rank) AS level FROM levels WHERE level <= ratio),
        targets AS (
            SELECT source, source_size,
                   least(2 * source_size, coalesce(level * weight, 2 * source_size))::DOUBLE AS target
            FROM ordered, level),
        plan AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM targets),
        summed AS (
            SELECT keyed.*, source_size, target, epochs, target - epochs * source_size AS budget,
                   sum(size) OVER (PARTITION BY keyed.source ORDER BY key, doc_id::VARCHAR
                                   ROWS UNBOUNDED PRECEDING) - size / 2 AS middle
            FROM keyed JOIN plan ON keyed.source IS NOT DISTINCT FROM plan.source)
        SELECT doc_id, size, source_size, target,
               (size * (epochs + (budget > 0 AND middle <= budget)::BIGINT))::BIGINT AS taken
        FROM summed""",
    "op8_chat": r"""
        WITH turns AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        placed AS (
            SELECT *, row_number() OVER conversation AS place,
                   CASE lag(coalesce(role, '?'), 1, 'start') OVER conversation
                       WHEN 'start' THEN role IN ('system', 'user')
                       WHEN 'system' THEN role = 'user'
                       WHEN 'user' THEN role = 'assistant'
                       WHEN 'assistant' THEN role = 'user' END AS in_place
            FROM turns WINDOW conversation AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text))
        SELECT conv_id, count(*) AS n_turns,
               min(place) FILTER (in_place IS NOT TRUE)::INTEGER AS wrong_turn,
               bool_and(in_place IS TRUE) AND coalesce(arg_max(role, place) = 'assistant', false) AS in_order,
               sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length(text) + len(regexp_extract_all(text, '[<\[\]\\]'))
                   + CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 18 WHEN 'assistant' THEN 12 END)::BIGINT AS formatted_chars
        FROM placed GROUP BY conv_id""",
    "op9_embeddings": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CASE WHEN len([x FOR x IN embedding IF isfinite(x)]) = len(embedding)
                                     AND len([x FOR x IN embedding IF x <> 0]) > 0 THEN embedding::DOUBLE[] END AS e
            FROM embeddings),
        linked AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        reached AS (
            SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reached r JOIN linked l ON r.b = l.a)
        SELECT vec_id, (SELECT count(*) FROM linked WHERE a = vec_id) AS n_links,
               (SELECT min(b) FROM reached WHERE a = vec_id) AS component_id,
               (SELECT min(b) FROM reached WHERE a = vec_id) = vec_id AS kept
        FROM v""",
    "op13_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL
              AND len([x FOR x IN embedding IF isfinite(x)]) = len(embedding)),
        scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
                   list_inner_product(a.e, b.e)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
        positives AS (
            SELECT * FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
        negatives AS (
            SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score,
                   n.score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank
            FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
             AND 100 * n.score BETWEEN 50 * p.score AND 95 * p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
        FROM negatives WHERE rank <= 3""",
}
SQL = {name: sql.strip() for name, sql in SQL.items()}
