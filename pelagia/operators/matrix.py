"""Genome × family matrix, architecture labels, clade × depth tables and exclusions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagia.functions.geo import UNKNOWN_ZONE, ZONE_ORDER, depth_zone
from pelagia.functions.text import architecture_label, label_codes, short_code
from pelagia.operators.ordering import first_by, top_categories_texts
from pelagia.session import cut_lineage


def drop_bad_queries(annotated: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows whose (family, best_query) is not on the exclusion list."""
    return annotated.join(bad.select("family", "best_query"), ["family", "best_query"], "left_anti")


def bad_target_set(annotated: DataFrame, bad: DataFrame, explicit: DataFrame) -> DataFrame:
    """Targets excluded everywhere: the explicit ids and every target recruited by a bad query."""
    recruited = annotated.join(bad.select("family", "best_query"), ["family", "best_query"], "left_semi")
    return recruited.select("target_id").unionByName(explicit.select(F.col("target").alias("target_id"))).distinct()


def drop_bad_targets(rows: DataFrame, bad_targets: DataFrame) -> DataFrame:
    return rows.join(bad_targets, "target_id", "left_anti")


def genome_family_counts(annotated: DataFrame) -> DataFrame:
    """Long matrix: distinct targets per (genome, family); rows without a genome are ignored."""
    placed = annotated.where(F.col("genome").isNotNull() & (F.col("genome") != ""))
    return placed.groupBy("genome", "family").agg(F.count_distinct("target_id").alias("n"))


def genome_family_matrix(
    annotated: DataFrame, order: Sequence[str], facts: Sequence[str] = (), order_col: str = "ord"
) -> DataFrame:
    """One row per genome: ``n_<family>`` columns, families present, label and first-seen facts."""
    counts = genome_family_counts(annotated)
    wide = counts.groupBy("genome").agg(
        *[F.coalesce(F.max(F.when(F.col("family") == f, F.col("n"))), F.lit(0)).alias(f"n_{f}") for f in order]
    )
    present = sum((F.col(f"n_{f}") > 0).cast("int") for f in order)
    label = architecture_label({f: F.col(f"n_{f}") for f in order}, order)
    wide = wide.withColumn("n_families_present", present).withColumn("architecture", label)
    if not facts:
        return wide
    placed = annotated.where(F.col("genome").isNotNull() & (F.col("genome") != ""))
    return wide.join(first_by(placed, ["genome"], [order_col], facts), "genome")


def add_facts(matrix: DataFrame, genomes: DataFrame, facts: Sequence[str]) -> DataFrame:
    """The matrix with the facts of each genome, from a table of genomes, so that no hit carries them; others are dropped."""
    return matrix.join(genomes.select("genome", *facts).dropDuplicates(["genome"]), "genome")


def architecture_summary(
    matrix: DataFrame, order: Sequence[str], top_n: int = 5, tops: Sequence[str] = ("genus", "species", "study")
) -> DataFrame:
    """Genomes, share, distinct studies and top taxa per label, most common label first."""
    # Two aggregates read the matrix; without a cut each would rebuild it from the hits.
    matrix = cut_lineage(matrix.select("architecture", "study", *[t for t in tops if t != "study"]))
    base = matrix.groupBy("architecture").agg(
        F.count(F.lit(1)).alias("n_genomes"),
        F.count_distinct(F.when(F.col("study") != "", F.col("study"))).alias("n_distinct_studies"),
    )
    share = F.col("n_genomes") * 100.0 / F.sum("n_genomes").over(Window.partitionBy())
    out = base.withColumn("pct_of_genomes", share)
    codes = label_codes(F.col("architecture"), order)
    by_code = F.array(*[F.struct(F.lit(short_code(f)).alias("c"), F.lit(f).alias("f")) for f in order])
    present = F.transform(F.filter(by_code, lambda e: F.array_contains(codes, e["c"])), lambda e: e["f"])
    out = out.withColumn("families_present", F.array_join(present, ","))
    texts = top_categories_texts(matrix, ["architecture"], {c: f"top_{c}" for c in tops}, top_n)
    return out.join(texts, "architecture", "left").orderBy(F.desc("n_genomes"), "architecture")


def clade_depth_counts(rows: DataFrame, clade: str, depth: str = "depth_m") -> DataFrame:
    """Distinct genomes and targets per (clade, depth zone); blank clades and depths keep a label."""
    keyed = rows.select(
        F.when(F.col(clade).isNull() | (F.col(clade) == ""), "(no clade)").otherwise(F.col(clade)).alias("clade"),
        F.when(F.col(depth).isNull(), UNKNOWN_ZONE).otherwise(depth_zone(F.col(depth))).alias("zone"),
        F.when(F.col("genome") != "", F.col("genome")).alias("genome"),
        F.when(F.col("target_id") != "", F.col("target_id")).alias("target_id"),
    )
    return keyed.groupBy("clade", "zone").agg(
        F.count_distinct("genome").alias("n_genomes"), F.count_distinct("target_id").alias("n_targets")
    )


def clade_depth_wide(counts: DataFrame, value: str = "n_genomes") -> DataFrame:
    """Clades by total genomes, one zero-filled column per zone in depth order."""
    wide = counts.groupBy("clade").agg(
        F.sum("n_genomes").alias("total_genomes"),
        *[
            F.coalesce(F.max(F.when(F.col("zone") == zone, F.col(value))), F.lit(0)).alias(zone)
            for zone in ZONE_ORDER
        ],
    )
    return wide.orderBy(F.desc("total_genomes"), "clade")


def zone_ordinal(rows: DataFrame, zone: str = "zone") -> DataFrame:
    """Rows with ``zone_order``, the place of the zone by depth rather than by alphabet."""
    place = F.array_position(F.array(*[F.lit(z) for z in ZONE_ORDER]), F.col(zone))
    return rows.withColumn("zone_order", place.cast("int"))


def corrected_architectures(matrix: DataFrame, order: Sequence[str], forced: str, carriers: DataFrame) -> DataFrame:
    """Genomes per family set after ``forced`` is added for carriers and removed for everyone else.

    Carriers with no matrix row are counted with the forced family alone; genomes left
    without any family are dropped.
    """
    present = F.array_compact(F.array(*[F.when(F.col(f"n_{f}") > 0, F.lit(f)) for f in order]))
    sets = matrix.select("genome", present.alias("families"))
    marked = sets.join(carriers.select("genome", F.lit(True).alias("_carrier")).distinct(), "genome", "full_outer")
    one = F.array(F.lit(forced))
    known = F.coalesce(F.col("families"), F.array().cast("array<string>"))
    fixed = F.when(F.col("_carrier"), F.array_union(known, one)).otherwise(F.array_except(known, one))
    return (
        marked.select(F.array_join(F.array_sort(fixed), "+").alias("architecture"))
        .where("architecture <> ''")
        .groupBy("architecture")
        .agg(F.count(F.lit(1)).alias("n_genomes"))
        .withColumn("has_forced", F.array_contains(F.split("architecture", r"\+"), forced))
        .withColumn("n_families", F.size(F.split("architecture", r"\+")))
    )


def top_architectures(sets: DataFrame, top_with: int = 30, top_without: int = 10, min_families: int = 5) -> DataFrame:
    """Most common sets with the forced family, and without it among sets of more than ``min_families``."""
    pool = sets.where(F.col("has_forced") | (F.col("n_families") > min_families))
    order = Window.partitionBy("has_forced").orderBy(F.desc("n_genomes"), "architecture")
    ranked = pool.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= F.when(F.col("has_forced"), top_with).otherwise(top_without))


def family_totals(sets: DataFrame) -> DataFrame:
    """Genomes per family over the sets that hold the forced family."""
    exploded = sets.where("has_forced").select(F.explode(F.split("architecture", r"\+")).alias("family"), "n_genomes")
    return exploded.groupBy("family").agg(F.sum("n_genomes").alias("n_genomes"))
