"""Registered queries of this subpackage, over whole tables, and their reference SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm import bpe_codec, exact_dedup, jaccard_join, mixing, periodic_runs, quality, sentence_spans, sentencepiece_codec, spans, suffix_dedup, token_rollup, topk, toxicity, whitening
from pelagia.llm.shared import materialize, table
from pelagia.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_exact_top_k", """
    WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w FROM embeddings
        WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.w, c.w)]) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""")
def op1_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    rows = topk.sparse_rows(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return topk.exact_top_k(rows.filter("id % 50 = 0"), rows, 5)


def piece_model() -> str:
    """The public merge-type vocabulary; its place is the ``public_tokenizers`` package's to say."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return sentencepiece_codec.encode_digests(table(spark, sf, "documents"), piece_model()).withColumnRenamed("id", "doc_id")


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    found = quality.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


@query("op4_source_mix")
def op4_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf, "documents"))
    return plan.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards"
    )


@query("op7_exact_dedup", r"""
    WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
    k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY bare ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size FROM n)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM k""")
def op7_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    found = toxicity.toxicity_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return spans.digest_columns(suffix_dedup.suffix_dedup(table(spark, sf, "documents")))


@query("op8_token_counts", r"""
    WITH t AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents),
    c AS (SELECT doc_id, source, lang, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
        length(regexp_replace(text, '[^!-/:-@\[-`{-~]+', '', 'g')) AS marks FROM t),
    v AS (SELECT doc_id, source, lang, 'words/1' AS tokenizer, words AS tokens FROM c
        UNION ALL SELECT doc_id, source, lang, 'words_marks/1', words + marks FROM c)
    SELECT source, lang, tokenizer, count(*) AS docs, CAST(sum(CASE WHEN doc_id % 5 = 1 THEN 2 * tokens ELSE tokens END) AS BIGINT) AS tokens
    FROM v WHERE doc_id % 7 <> 3 GROUP BY ALL""")
def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """All documents go in; every seventh is deleted, every fifth revised to twice its count; each batch is sent twice."""
    rows = materialize(token_rollup.counted(table(spark, sf, "documents")), "counts")
    rollup = token_rollup.Rollup(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/rollup-{uuid.uuid4().hex}")
    revised = rows.filter("id % 5 = 1").withColumn("before", F.col("tokens")).withColumn("tokens", F.col("tokens") * 2)
    gone = rows.filter("id % 7 = 3").withColumn("tokens", F.when(F.col("id") % 5 == 1, F.col("tokens") * 2).otherwise(F.col("tokens")))
    for batch, changes in enumerate([
        token_rollup.change(rows, "insert"), token_rollup.change(revised, "revise", F.col("before")), token_rollup.change(gone, "delete"),
    ]):
        rollup.commit(batch, changes)
        rollup.commit(batch, changes)
    return rollup.totals()


@query("op9_jaccard_join", r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS words FROM documents),
    g AS (SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
            ELSE list_distinct([array_to_string(words[i:i + 3], ' ') FOR i IN range(1, len(words) - 2)]) END) AS s FROM w),
    n AS (SELECT doc_id, count(*) AS n_shingles FROM g GROUP BY doc_id),
    o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * both_ >= 85 * (p.n_shingles + q.n_shingles - both_)),
    r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.c)
    SELECT d.doc_id, coalesce(n.n_shingles, 0) AS n_shingles, m.component_id
    FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)""")
def op9_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    found = jaccard_join.jaccard_components(table(spark, sf, "documents"), 4, Fraction(85, 100))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@query("op10_sentence_spans")
def op10_sentence_spans(spark: SparkSession, sf: str) -> DataFrame:
    return spans.digest_columns(sentence_spans.sentence_dedup(table(spark, sf, "documents"), by_content=True))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic_runs.periodic_runs(table(spark, sf, "documents"), F.crc32(F.col("doc_id").cast("string")))
    return periodic_runs.run_digests(found)


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    grid = whitening.grid_rows(table(spark, sf, "embeddings"))
    return whitening.whiten(grid, whitening.fit_whitening(grid)).withColumnRenamed("id", "vec_id")


def word_vocabulary() -> str:
    """The public lower-case vocabulary with word ends."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op13_bpe_codec")
def op13_bpe_codec(spark: SparkSession, sf: str) -> DataFrame:
    return bpe_codec.bpe_digests(table(spark, sf, "documents"), word_vocabulary()).withColumnRenamed("id", "doc_id")
