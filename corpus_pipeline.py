"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

Executors and workers live through all stages, so those with Python lower the session's limit of an Arrow batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm import exact_dedup, jaccard_join, mixing, sentencepiece_codec, toxicity
from pelagia.llm.queries import piece_model
from pelagia.llm.shared import small_batches, table
from pelagia.session import ensure_checkpoint_dir

ORACLE_SQL = None  # learned weights, the splitting tree and the vocabulary have no SQL form


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject.

    All rows of an id go if one of its texts is rejected; null ids, null and empty texts stay, repeated clean rows stay
    each, and every column passes through.
    """
    small_batches(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest, then the least id, then the first by its columns.

    Null, empty and blank texts form one group, so one of them stays; a null id comes last among ties.
    """
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class linked by five-word shingles at a similarity of 0.8 or more, the one of least id.

    Texts without words link with nothing and stay; a null id counts as the last; rows that repeat an id stay or go together.
    """
    small_batches(spark)
    return jaccard_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, by shard and shuffled within it; a document taken twice is two rows.

    Texts without words are never taken; a null source is a source; null and repeated ids come as often as planned for
    their id, source and size. The columns are those of ``docs``, whatever their names.
    """
    mixed = mixing.mix(docs)
    return mixed.toDF(*docs.columns, "mix_shard_").drop("mix_shard_")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every taken copy's ids and a digest of what they decode to, in place of its text.

    Null and empty texts have the end id alone; every row of ``docs`` gives one, repeated ones too.
    """
    small_batches(spark)
    tokens = sentencepiece_codec.encode_texts(docs.select("doc_id", "lang", "source", "text"), piece_model())
    return tokens.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources), ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; an empty table, or one that loses all its rows on the way, gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
