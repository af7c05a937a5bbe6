"""Exact dedup: a tree-merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagia.llm.shared import materialize, without_separators


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, row, run (its input partition), digest and length of the normalised text, points."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = without_separators(F.col(text_col))
    return docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("run"),
        F.unhex(F.sha2(bare, 256)).alias("digest"), F.octet_length(bare).alias("bare_bytes"),
        F.char_length(text).cast("long").alias("points"),
    )


def merge_runs(rows: DataFrame, fan_in: int = 16) -> DataFrame:
    """Winner and size of every digest, by rounds that each merge ``fan_in`` runs into one.

    A run is the digest-sorted list of one input partition. In round r, partitions whose run numbers agree after
    division by ``fan_in`` exchange their entries; equal digests (verified by the length of what was digested) keep
    the smallest of (fewer points last, id, row) and add their sizes. A group of copies reaches any task at most
    ``fan_in`` times, so a hot digest costs no more than a rare one.
    """
    best = F.struct((-F.col("points")).alias("neg"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("row").alias("row"))
    top = rows.agg(F.max("run")).first()[0]
    runs = rows.groupBy("run", "digest", "bare_bytes").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("size"))
    count = 1 + (top or 0)
    while count > 1:
        runs = (
            runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .groupBy("run", "digest", "bare_bytes").agg(F.min("best").alias("best"), F.sum("size").alias("size"))
        )
        count = -(-count // fan_in)
    return runs.select("digest", "bare_bytes", "best", "size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest.

    Texts are equal when identical after deleting every ``[\\x20\\x09-\\x0D]``; null reads as empty, so null, empty and
    blank texts form one group. The row with the most code points stays, then the smallest id (null ids last), then
    the first row: of repeated rows exactly one is kept. An empty table gives an empty result; other columns of
    ``docs`` are ignored, whatever their names.
    """
    rows = materialize(digest_rows(docs, id_col, text_col), "digests")
    winners = merge_runs(rows, fan_in).select("digest", "bare_bytes", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), "size")
    return rows.join(winners, ["digest", "bare_bytes"]).select(
        "id", "keep_id", F.col("size").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), "digest"
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept.

    Rows are matched by id and digest; of rows that repeat both, the first in the order of the columns stays.
    """
    null_safe = [F.coalesce(F.col("id"), F.lit(0)).alias("id0_"), F.col("id").isNull().alias("no_id_")]
    groups = exact_groups(docs, id_col, text_col).filter("kept").select(*null_safe, F.col("digest").alias("digest_"))
    keys = ["digest_", "id0_", "no_id_"]  # of the join and of the window, so that whole texts are dealt out once
    digest = F.unhex(F.sha2(without_separators(F.col(text_col)), 256))
    rows = docs.withColumn("digest_", F.coalesce(digest, F.lit(b"")))  # never null, and Spark sees so
    rows = rows.withColumn("id0_", F.coalesce(F.col(id_col), F.lit(0))).withColumn("no_id_", F.col(id_col).isNull())
    order = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(1)]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.join(groups, keys, "left_semi").withColumn("nth_", first).filter("nth_ = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
