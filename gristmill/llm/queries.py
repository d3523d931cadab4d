"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from functools import partial, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, labelled, language_id, ngram_join, packing, quality, secret_scan, substring_dedup, token_counts, toxicity
from .common import bounded_batches, in_fold, table, tokenizer_path


#: Files of the vocabulary that op5 and op7 use, found by each worker on its own machine.
VOCABULARY, RANKS = partial(tokenizer_path, "byte_bpe_50k.json"), partial(tokenizer_path, "byte_bpe_50k.tiktoken")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), in_fold(4, 2)
    rows = labelled.sample(docs, table(spark, sf_dir, "labels"), "quality", ~held, quality.SAMPLE)
    scored = quality.score(docs, quality.train(rows["text"].tolist(), rows["y"].to_numpy()))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, sf_dir, "documents")).drop("bucket")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), VOCABULARY)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.find_repeats(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY, RANKS)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), in_fold(4, 2)
    rows = labelled.sample(docs, table(spark, sf_dir, "labels"), "toxic", ~held, toxicity.SAMPLE)
    scored = toxicity.score(docs, toxicity.train(rows["text"].tolist(), rows["y"].to_numpy(dtype=float)))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), in_fold(3, 1)
    found = language_id.identify(docs, language_id.train(docs, ~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def bounded(query):
    """The query, in a session with small Arrow batches."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: bounded(f)
    for f in (
        op1_ngram_join,
        op2_secret_scan,
        op3_quality,
        op4_exact_dedup,
        op5_token_counts,
        op6_substring_dedup,
        op7_packing,
        op8_toxicity,
        op9_language_id,
        op10_decontaminate,
    )
}

ORACLE_SQL = {
    # classes of equal sets, pairs of them by shared shingles, and what each reaches by links
    "op1_ngram_join": r"""
        WITH RECURSIVE worded AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s
            FROM worded
        ), classes AS (
            SELECT row_number() OVER () AS c, s, len(s) AS n, least FROM (SELECT s, min(doc_id) AS least FROM sets WHERE len(s) > 0 GROUP BY s)
        ), tokens AS (
            SELECT c, n, unnest(s) AS t FROM classes
        ), pairs AS (
            SELECT a.c AS a, b.c AS b, count(*) AS shared, any_value(a.n) + any_value(b.n) - count(*) AS whole
            FROM tokens a JOIN tokens b ON a.t = b.t AND a.c < b.c GROUP BY a.c, b.c
        ), links AS (
            SELECT a, b FROM pairs WHERE 100 * shared >= 75 * whole UNION ALL SELECT b, a FROM pairs WHERE 100 * shared >= 75 * whole
        ), reach AS (
            SELECT c, c AS r FROM classes UNION SELECT reach.c, links.b FROM reach JOIN links ON links.a = reach.r
        ), named AS (
            SELECT reach.c, min(classes.least) AS component FROM reach JOIN classes ON classes.c = reach.r GROUP BY reach.c
        )
        SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(named.component, sets.doc_id) AS component_id
        FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN named ON named.c = classes.c
    """,
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
