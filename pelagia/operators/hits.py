"""Alignment hits: filters, best hits, per-family summaries, batches and combination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.functions.evidence import hit_tier
from pelagia.operators.ordering import exact_quantiles, ordered_index

# E-value cuts counted in the family summary, and identity quantiles.
EVALUE_CUTS = [1e-5, 1e-10, 1e-20]
IDENTITY_QUANTILES = {"min": 0.0, "p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "max": 1.0}

HIT_VALUES = ["evalue", "bits", "pident", "qcov", "tcov"]


def threshold_filter(
    hits: DataFrame,
    max_evalue: float = 1.0,
    min_qcov: float = 0.0,
    min_tcov: float = 0.0,
    min_pident: float = 0.0,
    min_bits: float = 0.0,
) -> DataFrame:
    """Rows that pass every cut; unreadable or blank values count as e-value 1 and 0 otherwise."""

    def number(name: str, default: float) -> Column:
        return F.coalesce(F.col(name).try_cast("double"), F.lit(default))

    return hits.where(
        (number("evalue", 1.0) <= max_evalue)
        & (number("qcov", 0.0) >= min_qcov)
        & (number("tcov", 0.0) >= min_tcov)
        & (number("pident", 0.0) >= min_pident)
        & (number("bits", 0.0) >= min_bits)
    )


def divergent_filter(
    hits: DataFrame, min_len: int = 150, max_len: int = 700, min_cov: float = 0.6, max_pident: float = 35.0
) -> DataFrame:
    """Full-length but divergent hits."""
    return hits.where(
        F.col("alnlen").between(min_len, max_len)
        & (F.col("qcov") >= min_cov)
        & (F.col("tcov") >= min_cov)
        & (F.col("pident") < max_pident)
    )


def best_hit_per_target(hits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Least e-value, then greatest bits, then least query; with the number of distinct queries.

    One aggregate combined before the shuffle, by sorting, since the best row is no single number;
    the distinct count expands to (target, query) first, so a hot target is spread over its queries.
    """
    order = F.struct("evalue", -F.col("bits"), "query", "pident", "qcov", "tcov")
    row = F.struct(F.col("query").alias("best_query"), *HIT_VALUES)
    return (
        hits.groupBy(*by, "target")
        .agg(F.min_by(row, order).alias("_best"), F.count_distinct("query").alias("n_queries_matching"))
        .select(*by, F.col("target").alias("target_id"), "_best.*", "n_queries_matching")
    )


def best_hit_by_bits(hits: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Greatest bits per query, tie by lower e-value; self hits and excluded targets removed first."""
    kept = hits.where(F.col("query") != F.col("target"))
    if excluded is not None:
        kept = kept.join(excluded.select("target").distinct(), "target", "left_anti")
    order = F.struct(-F.col("bits"), "evalue", "target", "pident", "qcov", "tcov")
    row = F.struct(F.col("target").alias("best_target"), *HIT_VALUES)
    return kept.groupBy("query").agg(F.min_by(row, order).alias("_best")).select("query", "_best.*")


def best_per_candidate(manifest: DataFrame, hits: DataFrame, score: str, fields: Sequence[str]) -> DataFrame:
    """Best hit by one score for every manifest row; candidates without a hit stay as ``no_hit``."""
    row = F.struct(score, *fields)
    order = F.struct(-F.col(score), *fields)
    best = hits.groupBy("candidate").agg(F.min_by(row, order).alias("_best"), F.count(F.lit(1)).alias("n_hits"))
    return (
        manifest.join(best, "candidate", "left")
        .withColumn("status", F.when(F.col("_best").isNull(), "no_hit").otherwise("hit"))
        .select(*manifest.columns, "_best.*", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "status")
    )


def best_per_gene_from_coordinates(hits: DataFrame) -> DataFrame:
    """Best hit per gene with coverages computed from coordinates, hit count and A–E tier."""
    order = F.struct(-F.col("bits"), "query", "pident", "qstart", "qend", "tstart", "tend")
    row = F.struct("query", "pident", "bits", "qstart", "qend", "qlen", "tstart", "tend", "tlen")
    best = hits.groupBy("gene").agg(F.min_by(row, order).alias("b"), F.count(F.lit(1)).alias("n_queries_hit"))
    qcov = (F.col("b.qend") - F.col("b.qstart") + 1) / F.col("b.qlen")
    tcov = (F.col("b.tend") - F.col("b.tstart") + 1) / F.col("b.tlen")
    return best.select(
        "gene",
        F.col("b.query").alias("best_query"),
        F.col("b.pident").alias("pident"),
        F.col("b.bits").alias("bits"),
        qcov.alias("qcov"),
        tcov.alias("tcov"),
        "n_queries_hit",
        hit_tier(F.col("b.pident"), qcov, tcov).alias("tier"),
    )


def family_summary(hits: DataFrame) -> DataFrame:
    """Per family: alignments, unique targets, targets under each e-value cut and over the coverage cuts."""
    best = best_hit_per_target(hits, ["family"])
    per_cut = [
        F.count_if(F.col("evalue") <= cut).alias(f"n_targets_evalue_{cut:g}".replace("-", "_")) for cut in EVALUE_CUTS
    ]
    targets = best.groupBy("family").agg(
        F.count(F.lit(1)).alias("n_unique_targets"),
        *per_cut,
        F.count_if(F.col("qcov") >= 0.5).alias("n_targets_qcov_half"),
        F.count_if((F.col("qcov") >= 0.5) & (F.col("tcov") >= 0.5)).alias("n_targets_both_cov_half"),
    )
    totals = hits.groupBy("family").agg(F.count(F.lit(1)).alias("n_alignments"))
    return totals.join(targets, "family", "left")


def identity_quantiles(hits: DataFrame, by: Sequence[str] = ("family",)) -> DataFrame:
    """Exact inclusive quantiles of identity per group."""
    return exact_quantiles(hits, by, {"identity": F.col("pident")}, IDENTITY_QUANTILES)


def queries_at_cap(hits: DataFrame, max_seqs: int, fraction: float = 0.95) -> DataFrame:
    """Queries whose hit count reaches ``fraction`` of the cap, as one row per query."""
    counts = hits.groupBy("query").agg(F.count(F.lit(1)).alias("n_hits"))
    return counts.where(F.col("n_hits") >= fraction * max_seqs)


def cap_warning(hits: DataFrame, by: Sequence[str], max_seqs: int, fraction: float = 0.95) -> DataFrame:
    """Warning flag, number and sorted list of capped queries per group."""
    per_query = hits.groupBy(*by, "query").agg(F.count(F.lit(1)).alias("n_hits"))
    capped = F.when(F.col("n_hits") >= fraction * max_seqs, F.col("query"))
    return per_query.groupBy(*by).agg(
        (F.count(capped) > 0).alias("query_hit_cap_warning"),
        F.count(capped).alias("n_queries_at_cap"),
        F.array_join(F.array_sort(F.collect_list(capped)), "|").alias("queries_at_cap"),
    )


def combine_targets(frames: Sequence[DataFrame]) -> DataFrame:
    """All families stacked; a target hit by several families keeps every row."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def summary_to_long(summary: DataFrame, key: str = "family") -> DataFrame:
    """(key, metric, value) rows of a wide summary, values as text."""
    metrics = [c for c in summary.columns if c != key]
    return summary.unpivot(key, [F.col(c).cast("string").alias(c) for c in metrics], "metric", "value")


def combine_summaries(long: DataFrame, metrics: Sequence[str], key: str = "family") -> DataFrame:
    """One row per family with a column per metric; metrics a family lacks stay blank."""
    wide = long.groupBy(key).pivot("metric", list(metrics)).agg(F.first("value", ignorenulls=True))
    return wide.select(key, *[F.coalesce(F.col(m), F.lit("")).alias(m) for m in metrics])


def batch_of(records: DataFrame, order: str, n_batches: int, batch_index: int, bucket: Column) -> DataFrame:
    """Round-robin slice ``batch_index`` of ``n_batches`` in file order; the index is range-checked."""
    if not 0 <= batch_index < n_batches:
        raise ValueError(f"batch_index {batch_index} is not in 0..{n_batches - 1}")
    indexed = ordered_index(records, [], bucket, [order], "_pos")
    return indexed.where(F.col("_pos") % n_batches == batch_index).drop("_pos")


def concat_batches(batches: DataFrame, n_batches: int, batch_col: str = "batch") -> DataFrame:
    """All batches as one frame, after checking that every batch 0..n-1 is present."""
    seen = batches.agg(F.count_distinct(batch_col)).first()[0]
    if seen != n_batches:
        raise ValueError(f"expected {n_batches} batches, found {seen}")
    return batches.drop(batch_col)
