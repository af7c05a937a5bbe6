"""Gene neighbourhoods: positions on scaffolds, anchor matching and windows around anchors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.functions.text import scaffold_of_gene, strip_terminal
from pelagia.operators.ordering import ordered_index


def anchor_sequences(hits: DataFrame, sequences: DataFrame) -> DataFrame:
    """Distinct (genome, sequence) of the hit targets; missing and empty sequences dropped.

    Pairs are made distinct by the digest of the sequence, and the sequence itself is fetched last, so that it is dealt
    out once per different text and not once per hit.
    """
    known = sequences.where(F.col("sequence").isNotNull() & (F.col("sequence") != ""))
    known = known.select("target", "sequence", F.unhex(F.sha2("sequence", 256)).alias("_h"))
    texts = known.dropDuplicates(["_h"]).select("_h", "sequence")
    pairs = hits.select("genome", "target").join(known.select("target", "_h").distinct(), "target")
    return pairs.select("genome", "_h").distinct().join(texts, "_h").select("genome", "sequence")


def gene_positions(genes: DataFrame, scaffold: str, order: Sequence[str], bucket: Column) -> DataFrame:
    """1-based position of every gene on its scaffold, in file order (not the number in its id).

    ``bucket`` never decreases along ``order``; it keeps a hot scaffold out of one task.
    """
    return ordered_index(genes, [scaffold], bucket, list(order), "_i").withColumn("pos", F.col("_i") + 1).drop("_i")


def with_scaffold(genes: DataFrame, gene: str = "gene_id") -> DataFrame:
    return genes.withColumn("scaffold", scaffold_of_gene(F.col(gene)))


def match_anchors(genes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Genes whose sequence equals an anchor of the same genome, one trailing ``*``/``X`` aside.

    The equi join is on (genome, hash of the sequence) with the sequence compared again.
    """
    left = genes.withColumn("_seq", strip_terminal(F.col("sequence"))).withColumn("_hash", F.xxhash64("_seq"))
    right = anchors.select("genome", strip_terminal(F.col("sequence")).alias("_aseq")).distinct()
    right = right.withColumn("_ahash", F.xxhash64("_aseq")).withColumnRenamed("genome", "_genome")
    same = (
        (F.col("genome") == F.col("_genome")) & (F.col("_hash") == F.col("_ahash")) & (F.col("_seq") == F.col("_aseq"))
    )
    return left.join(right, same, "left_semi").drop("_seq", "_hash")


def neighbourhood_windows(genes: DataFrame, is_anchor: Column, scaffold: str, window: int = 10) -> DataFrame:
    """Genes within ``window`` positions of any anchor, clipped at scaffold ends, overlaps merged.

    Anchors are opened to the positions they cover and met by (scaffold, position), a key
    that is unique per gene, so a scaffold with many genes is not one task.
    """
    anchors = genes.where(is_anchor).select(scaffold, "pos")
    reach = F.explode(F.sequence(F.col("pos") - window, F.col("pos") + window)).alias("pos")
    covered = anchors.select(scaffold, reach).distinct()
    return genes.join(covered, [scaffold, "pos"], "left_semi")


def first_genome_per_gene(genes: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per gene id over all genomes, the first in ``order`` wins."""
    rest = [c for c in genes.columns if c != "gene_id"]
    picked = genes.groupBy("gene_id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select("gene_id", "_row.*")


def recovery_status(genomes: DataFrame, genes: DataFrame, anchored: DataFrame, windows: DataFrame) -> DataFrame:
    """Per genome: ok, no_anchors or download_failed (no gene table), with genes, anchors and window size."""
    per = [
        (genes, "n_genes"),
        (anchored, "n_anchors"),
        (windows, "n_window_genes"),
    ]
    out = genomes.select("genome").distinct()
    for frame, name in per:
        out = out.join(frame.groupBy("genome").agg(F.count(F.lit(1)).alias(name)), "genome", "left")
    out = out.fillna(0, [name for _, name in per])
    status = (
        F.when(F.col("n_genes") == 0, "download_failed").when(F.col("n_anchors") == 0, "no_anchors").otherwise("ok")
    )
    return out.withColumn("status", status)


def copies_in_order(copies: DataFrame, genome: str, scaffold_no: str, gene_index: str) -> DataFrame:
    """Copies of a genome by numeric scaffold then gene index, with their 1-based ordinal."""
    number = F.col(scaffold_no).try_cast("int")
    indexed = ordered_index(
        copies.withColumn("_no", number), [genome], F.struct("_no", F.expr(f"{gene_index} DIV 100000")), ["_no", gene_index], "_i"
    )
    return indexed.withColumn("ordinal", F.col("_i") + 1).drop("_i", "_no")
