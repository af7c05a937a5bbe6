"""Where clusters live: spread on the sphere, depth, taxa, prevalence by cell, habitat and phylum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagia.functions.geo import grid_cell, unit_vector
from pelagia.operators.farthest import farthest_km
from pelagia.operators.ordering import (
    exact_medians,
    exact_quantiles,
    first_by,
    modal_values,
    ordered_index,
    top_categories_texts,
)
from pelagia.session import cut_lineage


def with_clusters(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rows with their cluster id; targets outside every cluster are dropped."""
    return rows.join(clusters.select(F.col("member").alias("target_id"), F.col("rep").alias("cluster_id")), "target_id")


def cluster_genomes(
    rows: DataFrame,
    facts: Sequence[str] = ("lat", "lon", "depth_m", "genus", "phylum", "study"),
    order: str = "ord",
    genomes: DataFrame | None = None,
) -> DataFrame:
    """One row per (cluster, genome): first-seen facts and the number of distinct targets.

    With a table of ``genomes`` the facts come from there, so that no hit carries them; genomes it lacks are dropped.
    """
    placed = rows.where(F.col("genome").isNotNull() & (F.col("genome") != ""))
    if genomes is not None:
        about = genomes.select("genome", *facts).dropDuplicates(["genome"])
        counted = placed.groupBy("cluster_id", "genome").agg(F.count_distinct("target_id").alias("n_target_ids"))
        return counted.join(about, "genome").select("cluster_id", "genome", *facts, "n_target_ids")
    first = F.min_by(F.struct(*facts), F.col(order)).alias("_first")
    return (
        placed.groupBy("cluster_id", "genome")
        .agg(first, F.count_distinct("target_id").alias("n_target_ids"))
        .select("cluster_id", "genome", "_first.*", "n_target_ids")
    )


def cluster_points(
    rows: DataFrame, facts: Sequence[str] = ("lat", "lon", "depth_m"), genomes: DataFrame | None = None
) -> DataFrame:
    """(cluster, genome) rows that have a position."""
    return cluster_genomes(rows, facts, genomes=genomes).where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def cluster_positions(rows: DataFrame, genomes: DataFrame) -> DataFrame:
    """(cluster, position) of every row whose genome has one: as :func:`cluster_points`, but the rows of a genome are not
    counted, so they meet the table of ``genomes`` without a shuffle by (cluster, genome)."""
    about = genomes.select("genome", "lat", "lon").dropDuplicates(["genome"]).where("lat IS NOT NULL AND lon IS NOT NULL")
    return rows.where("genome <> ''").select("cluster_id", "genome").join(about, "genome").select("cluster_id", "lat", "lon")


def spherical_dispersion(points: DataFrame, group: str = "cluster_id") -> DataFrame:
    """Resultant length (1 together, 0 spread out) and centroid of the unit vectors of a group."""
    x, y, z = unit_vector(F.col("lat"), F.col("lon"))
    means = points.groupBy(group).agg(
        F.count(F.lit(1)).alias("geo_n"), F.avg(x).alias("_x"), F.avg(y).alias("_y"), F.avg(z).alias("_z")
    )
    mx, my, mz = F.col("_x"), F.col("_y"), F.col("_z")
    return means.select(
        group,
        "geo_n",
        F.sqrt(mx * mx + my * my + mz * mz).alias("resultant_length"),
        F.degrees(F.atan2(mz, F.sqrt(mx * mx + my * my))).alias("centroid_lat"),
        F.degrees(F.atan2(my, mx)).alias("centroid_lon"),
    )


def strided_sample(points: DataFrame, group: str = "cluster_id", order: str = "genome", cap: int = 200) -> DataFrame:
    """At most ``cap`` evenly strided points per group; every point of groups up to ``cap``.

    Points are ordered by a hash of ``order`` so that pieces of a group are even in
    size whatever the ids look like.
    """
    hashed = points.withColumn("_h", F.md5(F.col(order)))
    indexed = ordered_index(hashed, [group], F.substring("_h", 1, 3), ["_h", order], "_k", total="_total")
    slot = indexed.withColumn("_i", F.expr(f"(_k * {cap} + _total - 1) DIV _total"))
    on_stride = (F.expr(f"(_i * _total) DIV {cap}") == F.col("_k")) & (F.col("_i") < cap)
    return slot.where((F.col("_total") <= cap) | on_stride).drop("_h", "_k", "_total", "_i")


def cluster_ecology(rows: DataFrame, top_n: int = 5, distances: bool = True, facts: DataFrame | None = None) -> DataFrame:
    """Targets, genomes, spread, median depth and top taxa per cluster, most genomes first.

    With ``distances`` also the greatest distance between two positions of the cluster. ``facts`` is a table of genomes
    (see :func:`cluster_genomes`); without it the rows carry their facts.
    """
    if facts is not None:
        rows = rows.join(facts.select("genome"), "genome", "left_semi")
    # Read by five aggregates below, so the (cluster, genome) table is written once.
    genomes = cut_lineage(cluster_genomes(rows, genomes=facts))
    points = genomes.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    placed = rows.where(F.col("genome").isNotNull() & (F.col("genome") != ""))
    targets = placed.groupBy("cluster_id").agg(F.count_distinct("target_id").alias("n_target_ids"))
    base = genomes.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_genomes")).join(targets, "cluster_id")
    depth = exact_quantiles(genomes, ["cluster_id"], {"median_depth_m": F.col("depth_m")}, {"": 0.5}, counts=True)
    depth = depth.withColumnRenamed("n_median_depth_m", "n_genomes_with_depth")
    out = base.join(spherical_dispersion(points), "cluster_id", "left")
    if distances:
        out = out.join(farthest_km(points), "cluster_id", "left")
    out = out.join(depth, "cluster_id", "left")
    names = {"genus": "top_genera", "phylum": "top_phyla", "study": "top_studies"}
    out = out.join(top_categories_texts(genomes, ["cluster_id"], names, top_n), "cluster_id", "left")
    return out.fillna(0, ["geo_n", "n_genomes_with_depth"]).orderBy(F.desc("n_genomes"), "cluster_id")


def annotate_clusters(rows: DataFrame, wanted: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Modal value of each category and the median depth over the genomes of the wanted clusters."""
    chosen = rows.join(wanted.select("cluster_id").distinct(), "cluster_id", "left_semi")
    genomes = cut_lineage(cluster_genomes(chosen, [*categories, "depth_m"]))
    out = genomes.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_genomes"))
    modal = modal_values(genomes, ["cluster_id"], {c: f"modal_{c}" for c in categories})
    out = out.join(modal, "cluster_id", "left")
    return out.join(exact_medians(genomes, ["cluster_id"], {"median_depth_m": F.col("depth_m")}), "cluster_id", "left")


def prevalence_by_cell(genomes: DataFrame, positives: DataFrame, size: int = 10, min_genomes: int = 20) -> DataFrame:
    """Share of positive genomes per grid cell, first row per genome, with a minimum-size flag."""
    first = first_by(genomes, ["genome"], ["ord"], ["lat", "lon"]).where("lat IS NOT NULL AND lon IS NOT NULL")
    marked = first.join(positives.select("genome", F.lit(1).alias("_pos")).distinct(), "genome", "left")
    cells = marked.groupBy(grid_cell(F.col("lat"), size).alias("lat_bin"), grid_cell(F.col("lon"), size).alias("lon_bin"))
    return cells.agg(F.count(F.lit(1)).alias("n_all"), F.count("_pos").alias("n_positive")).select(
        "*",
        (F.col("n_positive") * 100 / F.col("n_all")).alias("pct_positive"),
        (F.col("n_all") >= min_genomes).alias("passes_min"),
    )


def prevalence_by_habitat(
    genomes: DataFrame, positives: DataFrame, excluded: Sequence[str], min_genomes: int = 200
) -> DataFrame:
    """Share of positive genomes per habitat next to the overall share; excluded habitats left out."""
    kept = genomes.where(F.col("habitat").isNotNull() & ~F.col("habitat").isin(list(excluded)))
    marked = kept.join(positives.select("genome", F.lit(1).alias("_pos")).distinct(), "genome", "left")
    out = marked.groupBy("habitat").agg(F.count(F.lit(1)).alias("n_all"), F.count("_pos").alias("n_positive"))
    everything = Window.partitionBy()
    overall = F.sum("n_positive").over(everything) * 100 / F.sum("n_all").over(everything)
    return (
        out.withColumn("overall_pct", overall)
        .withColumn("pct_positive", F.col("n_positive") * 100 / F.col("n_all"))
        .where(F.col("n_all") >= min_genomes)
    )


def prevalence_and_contribution(
    genomes: DataFrame, positives: DataFrame, cluster_members: DataFrame, min_genomes: int = 500
) -> DataFrame:
    """Per phylum: prevalence, share of all positives and distinct clusters among positive genomes."""
    positive = positives.select("genome", F.lit(1).alias("_pos")).distinct()
    known = genomes.where((F.col("phylum") != "") & ~F.lower("phylum").startswith("unknown"))
    counts = known.join(positive, "genome", "left").groupBy("phylum").agg(
        F.count(F.lit(1)).alias("n_genomes"), F.count("_pos").alias("n_positive")
    )
    placed = cluster_members.join(positive, "genome", "left_semi").join(known.select("genome", "phylum"), "genome")
    clusters = placed.groupBy("phylum").agg(F.count_distinct("cluster_id").alias("n_clusters"))
    n_positive = positive.agg(F.count(F.lit(1)).alias("_all"))
    out = counts.where((F.col("n_genomes") >= min_genomes) & (F.col("n_positive") > 0)).join(clusters, "phylum", "left")
    return out.withColumn("_all", n_positive.scalar()).select(
        "phylum",
        "n_genomes",
        "n_positive",
        (F.col("n_positive") * 100 / F.col("n_genomes")).alias("prevalence"),
        (F.col("n_positive") * 100 / F.col("_all")).alias("share"),
        F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"),
    )


def depth_range_by_cluster(rows: DataFrame, genus: str, min_genomes: int = 1) -> DataFrame:
    """Median, least and greatest depth per cluster within one genus, shallowest median first."""
    genomes = cluster_genomes(rows.where(F.col("genus") == genus), ["depth_m"]).where("depth_m IS NOT NULL")
    base = genomes.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_genomes"), F.min("depth_m").alias("min_depth"), F.max("depth_m").alias("max_depth")
    )
    medians = exact_medians(genomes, ["cluster_id"], {"median_depth": F.col("depth_m")})
    return base.where(F.col("n_genomes") >= min_genomes).join(medians, "cluster_id").orderBy("median_depth", "cluster_id")


def cold_water_summary(genomes: DataFrame, top_n: int = 6, max_temp: float = 5.0) -> DataFrame:
    """The genera with most cold-water genomes: medians, least temperature, greatest depth."""
    cold = genomes.where(F.col("temp") <= max_temp)
    top = cold.groupBy("genus").agg(
        F.count(F.lit(1)).alias("n_genomes"), F.min("temp").alias("min_temp"), F.max("depth_m").alias("max_depth")
    )
    top = top.orderBy(F.desc("n_genomes"), "genus").limit(top_n)
    medians = exact_medians(cold, ["genus"], {"median_temp": F.col("temp"), "median_depth": F.col("depth_m")})
    return top.join(medians, "genus", "left")


def threshold_counts(rows: DataFrame, column: str, cuts: Sequence[float]) -> DataFrame:
    """Rows at or under each cut of a column, one output row per cut."""
    pairs = [F.struct(F.lit(float(c)).alias("cut"), F.count_if(F.col(column) <= c).alias("n_rows")) for c in cuts]
    return rows.agg(F.array(*pairs).alias("_a")).select(F.inline("_a"))


def global_and_local_clusters(
    ecology: DataFrame, global_max: float = 0.4, local_min: float = 0.85, min_genomes: int = 30
) -> DataFrame:
    """Clusters spread over the globe and clusters kept to one region, with their leading genus."""
    scope = F.when(F.col("resultant_length") < global_max, "global").when(
        F.col("resultant_length") > local_min, "local"
    )
    lead = F.regexp_replace(F.split("top_genera", "; ")[0], r" \(\d+\)$", "")
    return (
        ecology.where(F.col("n_genomes") >= min_genomes)
        .withColumn("scope", scope)
        .where("scope IS NOT NULL")
        .select("cluster_id", "scope", "n_genomes", "resultant_length", "median_depth_m", lead.alias("genus"))
    )
