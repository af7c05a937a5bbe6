"""Sinks: text tables, FASTA, per-family and chunked outputs, id lists."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.functions.text import clean_sequence, wrap_text
from pelagia.operators.ordering import ordered_index
from pelagia.operators.master import master_export
from pelagia.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the cluster's shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}/{name}"


def formatted(df: DataFrame, formats: Mapping[str, str]) -> DataFrame:
    """Every column as text: printf formats where given, blank for NULL, ``True``/``False`` for booleans."""
    out = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if name in formats:
            text = F.when(column.isNotNull(), F.format_string(formats[name], column))
        elif kind == "boolean":
            text = F.initcap(column.cast("string"))
        else:
            text = column.cast("string")
        out.append(F.coalesce(text, F.lit("")).alias(name))
    return df.select(*out)


def write_tsv(df: DataFrame, path: str, formats: Mapping[str, str] | None = None) -> None:
    """Headered tab-separated text."""
    formatted(df, formats or {}).write.mode("overwrite").options(sep="\t", header=True, emptyValue="", escape='"').csv(path)


def write_master_csv(view: DataFrame, path: str) -> None:
    """The master table in its fixed column order, repeated tokens removed; a missing column is an error."""
    formatted(master_export(view), {}).write.mode("overwrite").options(header=True, escape='"', emptyValue="").csv(path)


def fasta_header(name: str, tags: Sequence[tuple[str, str]] = ()) -> Column:
    """``>id key=value …``; tags without a value vanish."""
    parts = [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"{k}="), F.col(c).cast("string"))) for k, c in tags]
    return F.concat(F.lit(">"), F.concat_ws(" ", F.col(name), *parts))


def fasta_records(df: DataFrame, name: str, tags: Sequence[tuple[str, str]] = (), width: int = 60) -> DataFrame:
    """One text value per sequence: header line and wrapped sequence; empty sequences left out."""
    known = df.where(F.col("sequence").isNotNull() & (F.col("sequence") != ""))
    keep = [c for c in ("family", "chunk_index") if c in df.columns]
    return known.select(*keep, F.concat(fasta_header(name, tags), F.lit("\n"), wrap_text(F.col("sequence"), width)).alias("value"))


def write_fasta(df: DataFrame, path: str, name: str, tags: Sequence[tuple[str, str]] = ()) -> None:
    fasta_records(df, name, tags).select("value").write.mode("overwrite").text(path)


def write_family_fastas(members: DataFrame, path: str) -> DataFrame:
    """Representatives of every family in its own folder; returns sequences per family.

    The commit protocol makes the replacement all-or-nothing.
    """
    reps = members.where(F.col("protein_id") == F.col("cluster_representative"))
    fasta_records(reps, "protein_id").write.mode("overwrite").partitionBy("family").text(path)
    return reps.where("sequence <> ''").groupBy("family").agg(F.count(F.lit(1)).alias("n_sequences"))


def chunk_manifest(records: DataFrame, key: str, order: str, bucket: Column, size: int = 1000) -> DataFrame:
    """Cleaned sequences with raw and clean lengths, cleanup notes and the chunk of ``size`` they go to."""
    cleaned = records.withColumn("_c", clean_sequence(F.col("sequence"))).where(F.length("_c.clean") > 0)
    trimmed = F.when(F.col("_c.n_terminal_x") > 0, F.concat(F.lit("trimmed_terminal_X:"), F.col("_c.n_terminal_x")))
    replaced = F.when(F.col("_c.n_noncanonical") > 0, F.concat(F.lit("noncanonical_to_X:"), F.col("_c.n_noncanonical")))
    notes = F.concat_ws(";", trimmed, replaced)
    indexed = ordered_index(cleaned, [], bucket, [order], "_i")
    return indexed.select(
        key,
        F.col("_c.raw_length").alias("raw_length"),
        F.col("_c.clean_length").alias("clean_length"),
        F.when(notes == "", "none").otherwise(notes).alias("cleanup_notes"),
        F.expr(f"_i DIV {size}").alias("chunk_index"),
        F.col("_c.clean").alias("sequence"),
    )


def write_chunks(manifest: DataFrame, path: str, key: str) -> None:
    """One folder of FASTA records per chunk, each written by one task as one file."""
    fasta_records(manifest, key, width=80).repartition("chunk_index").write.mode("overwrite").partitionBy("chunk_index").text(path)


def write_ids(ids: DataFrame, key: str, path: str) -> None:
    """Sorted distinct ids, one per line."""
    ids.select(F.col(key).cast("string").alias("value")).distinct().orderBy("value").write.mode("overwrite").text(path)


def cluster_membership_rows(assignments: DataFrame) -> DataFrame:
    """Clustered (protein, family) rows ordered by family, cluster and protein."""
    columns = ["protein_id", "family", "cluster_id", "cluster_representative", "cluster_size"]
    return assignments.where("cluster_id IS NOT NULL").select(*columns).orderBy("family", "cluster_id", "protein_id")


def append_table(df: DataFrame, path: str) -> None:
    """Append-only Parquet output (evidence, phenotypes, run log, download manifest)."""
    df.write.mode("append").parquet(path)
