"""Filters and composed summaries over matrices, annotated rows and evidence tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia.operators.ordering import (
    category_counts,
    coarse_key,
    exact_medians,
    exact_quantiles,
    ordered_index,
    top_categories_text,
)
from pelagia.operators.stats import mantel_haenszel, two_by_two_by_stratum


# ---- filters ---------------------------------------------------------------------------


def qualifying_genomes(matrix: DataFrame, missing: str = "n_phaC", min_other: int = 5) -> DataFrame:
    """Genomes without the family but with strictly more than ``min_other`` families."""
    return matrix.where((F.col(missing) == 0) & (F.col("n_families_present") > min_other))


def usable_habitats(
    genomes: DataFrame, excluded: Sequence[str], positive: Column, min_all: int = 200, min_positive: int = 20
) -> DataFrame:
    """Habitats outside the exclusion list with enough screened and enough positive genomes."""
    kept = genomes.where(F.col("habitat").isNotNull() & ~F.col("habitat").isin(list(excluded)))
    counts = kept.groupBy("habitat").agg(F.count(F.lit(1)).alias("n_all"), F.count_if(positive).alias("n_positive"))
    return counts.where((F.col("n_all") >= min_all) & (F.col("n_positive") >= min_positive))


def with_climate(rows: DataFrame, climate: str = "temp", depth: str = "depth_m") -> DataFrame:
    """Rows with a usable climate value and a depth that is not negative."""
    return rows.where(F.col(climate).isNotNull() & ~F.isnan(climate) & (F.col(depth) >= 0))


def climate_metrics(rows: DataFrame, climate: str = "temp", depth: str = "depth_m") -> DataFrame:
    """How many rows pass :func:`with_climate` and how many fall to a negative depth."""
    has = F.col(climate).isNotNull() & ~F.isnan(climate)
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(has & (F.col(depth) >= 0)).alias("n_usable"),
        F.count_if(has & (F.col(depth) < 0)).alias("n_negative_depth"),
    )


def attrition(rows: DataFrame, steps: Sequence[tuple[str, Column]], passed: str = "kept") -> DataFrame:
    """Rows lost at each ordered step; a row counts at its first failing step only."""
    first = None
    for name, fails in steps:
        first = (F if first is None else first).when(F.coalesce(fails, F.lit(True)), F.lit(name))
    return rows.groupBy(first.otherwise(F.lit(passed)).alias("step")).agg(F.count(F.lit(1)).alias("n_rows"))


def context_gate(proteins: DataFrame, entries: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Proteins for which some entry that cites their own id mentions a context keyword."""
    text = F.lower(F.concat_ws(" ", "value", "comment"))
    found = F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(text, k))
    cited = entries.where(found).select("record", F.explode("proteins").alias("local_id")).distinct()
    return proteins.join(cited, ["record", "local_id"], "left_semi")


def excluded_gene_filter(entries: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Entries whose gene name and synonyms are all off the family's exclusion list."""
    banned = F.array(*[F.lit(g) for g in excluded]) if excluded else F.array().cast("array<string>")
    name = F.coalesce(F.array_contains(banned, F.col("gene_name")), F.lit(False))
    synonyms = F.coalesce(F.col("gene_synonyms"), F.array().cast("array<string>"))
    return entries.where(~name & ~F.arrays_overlap(synonyms, banned))


def extreme_quadrant_taxa(
    rows: DataFrame, max_temp: float = 5.0, min_predicted: float = 82.5, by: Sequence[str] = ("genus", "species", "family_name", "phylum")
) -> DataFrame:
    """Taxa of rows from cold water with a hot prediction: count, medians and studies."""
    chosen = rows.where((F.col("temp") <= max_temp) & (F.col("predicted") >= min_predicted))
    base = chosen.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_proteins"), F.array_join(F.sort_array(F.collect_set("study")), ",").alias("studies")
    )
    medians = exact_medians(chosen, by, {"median_temp": F.col("temp"), "median_depth": F.col("depth_m")})
    return base.join(medians, list(by), "left").orderBy(F.desc("n_proteins"), *by)


def low_oxygen_share(rows: DataFrame, by: str, oxygen: str = "oxygen", limit: float = 63.0) -> DataFrame:
    """Share of rows under the hypoxia limit per group."""
    known = rows.where(F.col(oxygen).isNotNull())
    low = F.count_if(F.col(oxygen) < limit)
    return known.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), low.alias("n_low"), (low * 100 / F.count(F.lit(1))).alias("pct_low")
    )


def keep_if_unknown(rows: DataFrame, score: str, minimum: float, group: str, min_members: int = 3) -> DataFrame:
    """Rows whose score is missing or high enough, in groups that keep at least ``min_members`` of them."""
    kept = rows.where(F.coalesce(F.col(score), F.lit(float(minimum))) >= minimum)
    large = kept.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_members)
    return kept.join(large.select(group), group, "left_semi")


# ---- evidence groups and copy number ---------------------------------------------------


def evidence_groups(genomes: DataFrame, targets: DataFrame, triads: DataFrame, models: DataFrame) -> DataFrame:
    """One exclusive evidence group per genome: triad, model support, other families, or nothing."""
    flags = (
        targets.join(triads.select("target_id", F.lit(True).alias("_t")).distinct(), "target_id", "left")
        .join(models.select("target_id", F.lit(True).alias("_m")).distinct(), "target_id", "left")
        .groupBy("genome")
        .agg(F.bool_or(F.coalesce("_t", F.lit(False))).alias("triad"), F.bool_or(F.coalesce("_m", F.lit(False))).alias("model"))
    )
    group = (
        F.when(F.col("triad"), "triad complete")
        .when(F.col("model"), "model support, no triad")
        .when(F.col("n_other") >= 5, "no support, five or more other families")
        .when(F.col("n_other") >= 1, "no support, one to four other families")
        .otherwise("family alone")
    )
    return genomes.join(flags, "genome").select("genome", group.alias("evidence_group"))


def corrected_copies(matrix: DataFrame, count: str, bad_links: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Copy number less the genome's excluded targets, zero and audited artifacts dropped."""
    bad = bad_links.groupBy("genome").agg(F.count(F.lit(1)).alias("_bad"))
    corrected = F.greatest(F.col(count) - F.coalesce("_bad", F.lit(0)), F.lit(0))
    out = matrix.where(F.col(count) > 0).join(bad, "genome", "left").withColumn("n_copies", corrected).drop("_bad")
    return out.where("n_copies > 0").join(artifacts.select("genome").distinct(), "genome", "left_anti")


def multicopy_by(genomes: DataFrame, group: str, copies: str = "n_copies", min_genomes: int = 1) -> DataFrame:
    """Share with two or more copies and mean copies per group."""
    out = genomes.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_genomes"),
        F.count_if(F.col(copies) >= 2).alias("n_multicopy"),
        (F.count_if(F.col(copies) >= 2) * 100 / F.count(F.lit(1))).alias("pct_multicopy"),
        F.avg(copies).alias("mean_copies"),
    )
    return out.where(F.col("n_genomes") >= min_genomes)


def multicopy_tests(genomes: DataFrame, group: str, stratum: str, copies: str = "n_copies", with_p: bool = True) -> DataFrame:
    """Stratified association of being multicopy with each group."""
    tables = two_by_two_by_stratum(genomes, group, stratum, F.col(copies) >= 2)
    return mantel_haenszel(tables, [group], with_p=with_p)


# Copy-number buckets as (label, greatest count).
COPY_BUCKETS = [("1", 1), ("2", 2), ("3-4", 4), ("5-9", 9), ("10+", None)]


def copy_bucket(copies: Column) -> Column:
    label = None
    for name, high in COPY_BUCKETS[:-1]:
        label = (F if label is None else label).when(copies <= high, F.lit(name))
    return label.otherwise(F.lit(COPY_BUCKETS[-1][0]))


def contamination_by_copies(genomes: DataFrame, copies: str = "n_copies", value: str = "contamination") -> DataFrame:
    """Mean and standard error of contamination per copy bucket."""
    known = genomes.where(F.col(value).isNotNull())
    return known.groupBy(copy_bucket(F.col(copies)).alias("copies")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean_contamination"),
        (F.stddev_samp(value) / F.sqrt(F.count(F.lit(1)))).alias("sem"),
    )


# Cuts of the multicopy audit.
FULL_LENGTH = 500
LEGIT_TRIAD_MIN, LEGIT_CLUSTER_MIN = 0.6, 0.6
ARTIFACT_TRIAD_MAX, ARTIFACT_CLUSTER_MAX = 0.3, 0.3
CONTAMINATION_MAX = 10.0


def multicopy_audit(
    copies: DataFrame, triads: DataFrame, lengths: DataFrame, clusters: DataFrame, places: DataFrame, quality: DataFrame,
    full_length: int = FULL_LENGTH,
) -> DataFrame:
    """Per genome: triad, length and cluster shares of its copies, contig spread and a composite call.

    ``copies`` is (genome, target_id); shares use only the copies for which the fact is known.
    The median length is the upper one, at position n//2 of the sorted lengths.
    """
    rows = (
        copies.join(triads.select("target_id", F.col("flag").alias("triad")), "target_id", "left")
        .join(lengths.select("target_id", "length"), "target_id", "left")
        .join(clusters.select(F.col("member").alias("target_id"), F.col("rep").alias("cluster_id")), "target_id", "left")
        .join(places.select("target_id", "genome", "scaffold"), ["target_id", "genome"], "left")
    )
    on_scaffold = rows.where("scaffold IS NOT NULL").groupBy("genome", "scaffold").agg(F.count(F.lit(1)).alias("_n"))
    contigs = on_scaffold.groupBy("genome").agg(F.count(F.lit(1)).alias("n_contigs"), F.max("_n").alias("max_on_contig"))
    base = rows.groupBy("genome").agg(
        F.count(F.lit(1)).alias("n_targets"),
        F.try_divide(F.count_if("triad"), F.count("triad")).alias("pct_triad"),
        F.try_divide(F.count_if(F.col("length") >= full_length), F.count("length")).alias("pct_full_length"),
        F.count_distinct("cluster_id").alias("n_distinct_clusters"),
        F.try_divide(F.count_distinct("cluster_id"), F.count("cluster_id")).alias("pct_distinct_clusters"),
    )
    median = exact_quantiles(rows, ["genome"], {"median_length": F.col("length")}, {"": 0.5}, "upper")
    out = base.join(median, "genome", "left").join(contigs, "genome", "left").join(quality, "genome", "left")
    out = out.fillna(0, ["n_contigs", "max_on_contig"])
    triad, distinct, dirt = F.col("pct_triad"), F.col("pct_distinct_clusters"), F.col("contamination")
    clean = dirt.isNull() | (dirt <= CONTAMINATION_MAX)
    call = (
        F.when(triad.isNull() | distinct.isNull(), "insufficient_data")
        .when((triad >= LEGIT_TRIAD_MIN) & (distinct >= LEGIT_CLUSTER_MIN) & clean, "likely_legit")
        .when((triad < ARTIFACT_TRIAD_MAX) | (distinct < ARTIFACT_CLUSTER_MAX) | ~clean, "likely_artifact")
        .otherwise("uncertain")
    )
    return out.withColumn("call", call)


def high_copy_by_study(genomes: DataFrame, copies: str, high: int = 5, min_genomes: int = 20) -> DataFrame:
    """Share of high-copy genomes and greatest copy number per study."""
    out = genomes.groupBy("study").agg(
        F.count(F.lit(1)).alias("n_genomes"),
        F.count_if(F.col(copies) >= high).alias("n_high"),
        (F.count_if(F.col(copies) >= high) * 100 / F.count(F.lit(1))).alias("pct_high"),
        F.max(copies).alias("max_copies"),
    )
    return out.where(F.col("n_genomes") >= min_genomes)


def tail_concentration(genomes: DataFrame, category: str, top_n: int = 5) -> DataFrame:
    """How much of the rows the ``top_n`` most frequent categories hold."""
    counts = category_counts(genomes, [], category)
    top = counts.orderBy(F.desc("n"), category).limit(top_n).agg(F.sum("n")).scalar()
    return counts.agg(F.count(F.lit(1)).alias("n_categories"), F.sum("n").alias("n_rows")).withColumn("n_top", top).withColumn(
        "pct_top", F.col("n_top") * 100 / F.col("n_rows")
    )


# ---- taxonomy roll-ups -----------------------------------------------------------------


def penetrance_and_consistency(matrix: DataFrame, qualifies: Column, min_qualifying: int = 20) -> DataFrame:
    """Per genus: share of genomes that qualify and share of those with the modal architecture."""
    known = matrix.where(F.col("genus") != "")
    base = known.groupBy("genus").agg(F.count(F.lit(1)).alias("n_total"), F.count_if(qualifies).alias("n_qualifying"))
    arch = category_counts(known.where(qualifies), ["genus"], "architecture")
    modal = arch.groupBy("genus").agg(
        F.min_by(F.struct("architecture", "n"), F.struct(-F.col("n"), "architecture")).alias("_m"),
        F.count(F.lit(1)).alias("n_architectures"),
    )
    out = base.where(F.col("n_qualifying") >= min_qualifying).join(modal, "genus")
    return out.select(
        "genus",
        "n_total",
        "n_qualifying",
        (F.col("n_qualifying") * 100 / F.col("n_total")).alias("penetrance"),
        (F.col("_m.n") * 100 / F.col("n_qualifying")).alias("consistency"),
        F.col("_m.architecture").alias("top_architecture"),
        "n_architectures",
    )


def folded_hierarchy(rows: DataFrame, parent: str, child: str, min_parent: int, min_child: int) -> DataFrame:
    """Counts per (parent, child), small parents as ``Other`` and small children as ``N smaller``."""
    counts = rows.where((F.col(parent) != "") & (F.col(child) != "")).groupBy(parent, child).agg(F.count(F.lit(1)).alias("n"))
    sized = counts.withColumn("_p", F.sum("n").over(Window.partitionBy(parent)))
    small = F.col("n") < min_child
    sized = sized.withColumn("_small", F.count_if(small).over(Window.partitionBy(parent)))
    big_parent = F.col("_p") >= min_parent
    labelled = sized.select(
        F.when(big_parent, F.col(parent)).otherwise("Other").alias(parent),
        F.when(~big_parent, "").when(small, F.concat(F.col("_small").cast("string"), F.lit(" smaller"))).otherwise(F.col(child)).alias(child),
        "n",
    )
    return labelled.groupBy(parent, child).agg(F.sum("n").alias("n"))


def single_phylum_clusters(rows: DataFrame) -> DataFrame:
    """Clusters found in exactly one phylum, with their first-seen domain, class and order."""
    known = rows.where(F.col("phylum") != "")
    def first(column: str, default: str) -> Column:
        seen = F.min_by(column, F.when(F.col(column) != "", F.col("ord")))
        return F.coalesce(seen, F.lit(default)).alias(column)

    return (
        known.groupBy("cluster_id")
        .agg(
            F.count_distinct("phylum").alias("_n"),
            F.max("phylum").alias("phylum"),
            first("domain_name", "Bacteria"),
            first("class_name", "Unknown class"),
            first("order_name", "Unknown order"),
        )
        .where("_n = 1")
        .drop("_n")
    )


def taxonomy_leaves(clusters: DataFrame, top_classes: int = 3, top_orders: int = 2) -> DataFrame:
    """(phylum, class, order) → leaf: top classes and orders keep their name, the rest are folded.

    Counts are reduced to one row per (phylum, class, order) before any ranking.
    """
    counts = clusters.groupBy("phylum", "class_name", "order_name").agg(F.count(F.lit(1)).alias("n"))
    per_class = counts.groupBy("phylum", "class_name").agg(F.sum("n").alias("class_n"))
    rank_class = F.row_number().over(Window.partitionBy("phylum").orderBy(F.desc("class_n"), "class_name"))
    per_class = per_class.withColumn("class_rank", rank_class)
    n_small = F.count_if(F.col("class_rank") > top_classes).over(Window.partitionBy("phylum"))
    per_class = per_class.withColumn("_small_classes", n_small)
    rank_order = F.row_number().over(Window.partitionBy("phylum", "class_name").orderBy(F.desc("n"), "order_name"))
    ranked = counts.withColumn("order_rank", rank_order)
    small_orders = F.count_if(F.col("order_rank") > top_orders).over(Window.partitionBy("phylum", "class_name"))
    ranked = ranked.withColumn("_small_orders", small_orders).join(per_class, ["phylum", "class_name"])
    folded_class = F.col("class_rank") > top_classes
    leaf_class = F.when(folded_class, F.concat(F.col("_small_classes").cast("string"), F.lit(" smaller classes"))).otherwise(F.col("class_name"))
    leaf_order = (
        F.when(folded_class, F.lit("(mixed)"))
        .when(F.col("order_rank") > top_orders, F.concat(F.col("_small_orders").cast("string"), F.lit(" smaller orders")))
        .otherwise(F.col("order_name"))
    )
    return ranked.select("phylum", "class_name", "order_name", "n", leaf_class.alias("leaf_class"), leaf_order.alias("leaf_order"))


def leaf_counts(leaves: DataFrame) -> DataFrame:
    return leaves.groupBy("phylum", "leaf_class", "leaf_order").agg(F.sum("n").alias("n_clusters"))


def rate_per_leaf(genomes: DataFrame, leaves: DataFrame, positive: Column) -> DataFrame:
    """Share of positive genomes per leaf of the folded taxonomy."""
    mapping = leaves.select("phylum", "class_name", "order_name", "leaf_class", "leaf_order")
    placed = genomes.join(mapping, ["phylum", "class_name", "order_name"])
    return placed.groupBy("phylum", "leaf_class", "leaf_order").agg(
        F.count(F.lit(1)).alias("n_genomes"), (F.count_if(positive) * 100 / F.count(F.lit(1))).alias("pct_positive")
    )


def host_breadth(genomes: DataFrame, cluster_id: str) -> DataFrame:
    """Genomes per genus of one cluster, with the number of genera and phyla it reaches."""
    mine = genomes.where(F.col("cluster_id") == cluster_id)
    counts = mine.groupBy("genus", "phylum").agg(F.count(F.lit(1)).alias("n_genomes"))
    n_genera, n_phyla = (counts.agg(F.count_distinct(c)).scalar() for c in ("genus", "phylum"))
    return counts.withColumn("n_genera", n_genera.cast("int")).withColumn("n_phyla", n_phyla.cast("int"))


def class_by_phylum(copies: DataFrame, classes: DataFrame, genomes: DataFrame, top_n: int = 10) -> DataFrame:
    """Synthase classes per phylum; class III is split by which partner family the genome carries."""
    placed = copies.join(classes, "target_id").join(genomes.select("genome", "phylum", "has_e", "has_r"), "genome")
    label = (
        F.when(F.col("model_class").isin("I", "II"), F.col("model_class"))
        .when((F.col("model_class") == "III") & F.col("has_e"), "III")
        .when((F.col("model_class") == "III") & F.col("has_r"), "IV")
        .when(F.col("model_class") == "III", "III/IV, no partner found")
        .otherwise("unassigned")
    )
    names = ["I", "II", "III", "IV", "III/IV, no partner found", "unassigned"]
    counts = placed.where(F.col("phylum") != "").withColumn("_c", label).groupBy("phylum").agg(
        F.count(F.lit(1)).alias("n_copies"),
        F.count_if("confident").alias("n_confident"),
        *[F.count_if(F.col("_c") == n).alias(n) for n in names],
    )
    return counts.orderBy(F.desc("n_copies"), "phylum").limit(top_n)


def marker_completeness(hits: DataFrame, genomes: DataFrame, markers: Sequence[str], modules: dict[str, Sequence[str]]) -> DataFrame:
    """Per genome: yes/no per marker, number of markers and yes/no per complete module."""
    present = hits.where(F.col("marker").isin(list(markers))).groupBy("genome").agg(
        F.sort_array(F.collect_set("marker")).alias("_present")
    )
    out = genomes.join(present, "genome", "left")
    have = F.coalesce("_present", F.array().cast("array<string>"))
    yes = lambda test: F.when(test, "yes").otherwise("no")
    columns = [yes(F.array_contains(have, m)).alias(f"has_{m}") for m in markers]
    for name, core in modules.items():
        columns.append(yes(F.size(F.array_except(F.array(*[F.lit(m) for m in core]), have)) == 0).alias(f"complete_{name}"))
    return out.select(*genomes.columns, F.size(have).alias("n_markers"), F.array_join(have, ",").alias("markers"), *columns)


def completeness_rollup(table: DataFrame, by: str, flags: Sequence[str], quality: str = "completeness") -> DataFrame:
    """Genomes, mean and least quality, and yes-counts per group."""
    return table.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_genomes"),
        F.avg(quality).alias("mean_quality"),
        F.min(quality).alias("min_quality"),
        *[F.count_if(F.col(f) == "yes").alias(f"n_{f}") for f in flags],
    )


# ---- routes ----------------------------------------------------------------------------


def with_routes(matrix: DataFrame) -> DataFrame:
    """Route flags and labels from the presence of families A+B, G and J."""
    ab = (F.col("n_phaA") > 0) & (F.col("n_phaB") > 0)
    g, j = F.col("n_phaG") > 0, F.col("n_phaJ") > 0
    combo = F.concat(F.when(ab, "AB").otherwise(""), F.when(g, "G").otherwise(""), F.when(j, "J").otherwise(""))
    strategy = F.when(g & j, "Both (G+J)").when(g, "FAS-linked only (G)").when(j, "Beta-oxidation only (J)").otherwise("Neither")
    return (
        matrix.withColumn("route_ab", ab)
        .withColumn("route_g", g)
        .withColumn("route_j", j)
        .withColumn("combo", F.when(combo == "", "(none)").otherwise(combo))
        .withColumn("strategy", strategy)
    )


def route_counts(routed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Genomes and route shares per group."""
    n = F.count(F.lit(1))
    return routed.groupBy(*by).agg(
        n.alias("n_genomes"),
        (F.count_if("route_ab") * 100 / n).alias("pct_ab"),
        (F.count_if("route_g") * 100 / n).alias("pct_g"),
        (F.count_if("route_j") * 100 / n).alias("pct_j"),
    )


def cluster_route_association(routed: DataFrame, placed: DataFrame, min_genomes: int = 30, with_p: bool = True) -> DataFrame:
    """Per cluster: route shares, leading phylum share and the stratified route test."""
    rows = placed.join(routed.select("genome", "phylum", "route_g", "route_j", "strategy"), "genome")
    n = F.count(F.lit(1))
    base = rows.groupBy("cluster_id").agg(
        n.alias("n_genomes"),
        (F.count_if("route_g") * 100 / n).alias("pct_g"),
        (F.count_if("route_j") * 100 / n).alias("pct_j"),
        F.count_if(F.col("strategy") == "Neither").alias("n_neither"),
    )
    counted = category_counts(rows, ["cluster_id"], "phylum", "np")
    top = counted.groupBy("cluster_id").agg(
        F.min_by(F.struct("phylum", "np"), F.struct(-F.col("np"), "phylum")).alias("_t")
    )
    tests = mantel_haenszel(two_by_two_by_stratum(rows, "cluster_id", "phylum", F.col("route_g")), ["cluster_id"], with_p=with_p)
    out = base.where(F.col("n_genomes") >= min_genomes).join(top, "cluster_id").join(tests, "cluster_id", "left")
    share = (F.col("_t.np") * 100 / F.col("n_genomes")).alias("top_phylum_pct")
    return out.select(*base.columns, F.col("_t.phylum").alias("top_phylum"), share, *[c for c in tests.columns if c != "cluster_id"])


# ---- binned and grouped summaries ------------------------------------------------------


def binned_medians(rows: DataFrame, x: str, y: str, width: float = 5, min_rows: int = 25) -> DataFrame:
    """Median of ``y`` per bin of ``x``, at the bin centre, for bins with enough rows."""
    binned = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_b", F.floor(F.col(x) / width) * width)
    out = exact_quantiles(binned, ["_b"], {"median": F.col(y)}, {"": 0.5}, counts=True)
    return out.where(F.col("n_median") >= min_rows).select(
        (F.col("_b") + width / 2).alias("centre"), "median", F.col("n_median").alias("n")
    )


def running_windows(
    rows: DataFrame, x: str, y: str, width: float = 6, step: float = 2, min_rows: int = 25, top_x: float = 100
) -> DataFrame:
    """Median and quartiles of ``y`` in overlapping half-open windows of ``x`` over [0, ``top_x``].

    Window k is [k·step, k·step + width).  A value is opened to the width/step windows
    that hold it, instead of being range-joined to a list of centres.
    """
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    low = F.greatest(F.floor((F.col(x) - width) / step) + 1, F.lit(0))
    top = F.least(F.floor(F.col(x) / step), F.lit(int((top_x - width) // step)))
    windows = F.when(low <= top, F.sequence(low, top)).otherwise(F.array().cast("array<bigint>"))
    opened = known.withColumn("_k", F.explode(windows))
    out = exact_quantiles(opened, ["_k"], {"v": F.col(y)}, {"p25": 0.25, "median": 0.5, "p75": 0.75}, counts=True)
    return out.where(F.col("n_v") >= min_rows).select(
        (F.col("_k") * step + width / 2).alias("centre"),
        F.col("v_p25").alias("p25"),
        F.col("v_median").alias("median"),
        F.col("v_p75").alias("p75"),
        F.col("n_v").alias("n"),
    )


def threshold_shares(rows: DataFrame, x: str, y: str, edges: Sequence[float], cuts: Sequence[float]) -> DataFrame:
    """Share of ``y`` at or over each cut, per half-open bin of ``x`` between the edges."""
    label = None
    for low, high in zip(edges[:-1], edges[1:]):
        inside = (F.col(x) >= low) & (F.col(x) < high)
        label = (F if label is None else label).when(inside, F.lit(f"{low:g}-{high:g}"))
    binned = rows.withColumn("bin", label).where("bin IS NOT NULL")
    return binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg((F.col(y) >= c).cast("int")).alias(f"share_ge_{c:g}") for c in cuts]
    )


def docking_preference(scores: DataFrame, references: Sequence[str]) -> DataFrame:
    """Score of every (receptor, ligand) against the mean of the reference receptors, and per heavy atom."""
    mean = scores.groupBy("ligand").agg(F.avg(F.when(F.col("receptor").isin(list(references)), F.col("affinity"))).alias("baseline"))
    return scores.join(mean, "ligand", "left").select(
        "receptor", "ligand", "carbons", "affinity",
        (F.col("affinity") - F.col("baseline")).alias("vs_reference"),
        F.try_divide("affinity", "heavy_atoms").alias("ligand_efficiency"),
    )


def chain_length_shift(scores: DataFrame, short: int = 4, long: int = 8) -> DataFrame:
    """Affinity at the long chain less affinity at the short one, per receptor."""
    at = lambda n: F.avg(F.when(F.col("carbons") == n, F.col("affinity")))
    return scores.groupBy("receptor").agg((at(long) - at(short)).alias("shift")).where("shift IS NOT NULL")


def noise_floor(scores: DataFrame, first: str, second: str) -> DataFrame:
    """Mean and range of the disagreement of two reference receptors over their common ligands."""
    of = lambda name: F.avg(F.when(F.col("receptor") == name, F.col("affinity")))
    gaps = scores.groupBy("ligand").agg(F.abs(of(first) - of(second)).alias("gap")).where("gap IS NOT NULL")
    return gaps.agg(F.avg("gap").alias("mean_gap"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"))


def cross_genome_conservation(copies: DataFrame) -> DataFrame:
    """Copies per (cluster, genome) and the number of genomes that share the cluster."""
    per = copies.groupBy("cluster_id", "genome").agg(F.count(F.lit(1)).alias("n_copies"))
    shared = per.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_genomes_sharing"))
    return per.join(shared, "cluster_id")


def variant_table(rows: DataFrame, top_n: int = 5) -> DataFrame:
    """Genomes and genus histogram per exact variant, from its counts by genus.

    Rows are dealt by variant and genome before they are made distinct: few repeat, so a map task would hold nearly all
    of its rows in a hash table to no use.
    """
    one = rows.select("target_id", "genome", "genus").repartition("target_id", "genome").distinct()
    counted = one.groupBy("target_id", "genus").agg(F.count(F.lit(1)).alias("n"))
    named = F.col("genus").isNotNull() & (F.col("genus") != "")
    mine = Window.partitionBy("target_id")
    ranked = counted.select(
        "target_id", "genus", "n", F.sum("n").over(mine).alias("n_genomes"),
        F.row_number().over(mine.orderBy(F.desc(named), F.desc("n"), "genus")).alias("rank"),
    ).where(F.col("rank") <= top_n)
    entry = F.when(named, F.struct("rank", F.concat("genus", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("t")))
    entries = F.array_sort(F.collect_list(entry))
    text = F.when(F.size(entries) > 0, F.array_join(F.transform(entries, lambda e: e["t"]), "; "))
    return ranked.groupBy("target_id").agg(F.max("n_genomes").alias("n_genomes"), text.alias("genera"))


def genome_breakdown(copies: DataFrame, flag: str, key: str = "target_id") -> DataFrame:
    """Copies per genome with any/all flags and the sorted ids with and without the flag.

    The id lists are the report itself; a genome holds at most its own genes.
    """
    on = F.col(flag)
    return copies.groupBy("genome").agg(
        F.count(F.lit(1)).alias("n_copies"),
        F.bool_or(on).alias("any_flag"),
        F.bool_and(on).alias("all_flag"),
        F.array_join(F.sort_array(F.collect_set(F.when(on, F.col(key)))), ",").alias("with_flag"),
        F.array_join(F.sort_array(F.collect_set(F.when(~on, F.col(key)))), ",").alias("without_flag"),
    )


def mean_counts_by_group(matrix: DataFrame, families: Sequence[str], high: Column) -> DataFrame:
    """Mean family counts of high-copy and low-copy genomes."""
    group = F.when(high, "high").otherwise("low").alias("group")
    return matrix.groupBy(group).agg(F.count(F.lit(1)).alias("n_genomes"), *[F.avg(f"n_{f}").alias(f"mean_{f}") for f in families])


def longest_target_per_genome(links: DataFrame, lengths: DataFrame) -> DataFrame:
    """The longest target of every genome, least id on ties."""
    rows = links.select("genome", "target_id").distinct().join(lengths, "target_id", "left")
    best = F.min_by(F.struct("target_id", "length"), F.struct(-F.coalesce("length", F.lit(0)), "target_id"))
    return rows.groupBy("genome").agg(best.alias("_b")).select("genome", "_b.*")


def divergent_candidates(
    longest: DataFrame, best: DataFrame, facts: DataFrame, max_pident: float = 35.0, lengths: tuple[int, int] = (150, 700), min_cov: float = 0.6
) -> DataFrame:
    """Genomes whose longest target is far from its nearest neighbour but well covered."""
    hits = best.withColumnRenamed("query", "target_id")
    rows = longest.join(hits, "target_id").where(
        (F.col("pident") < max_pident) & F.col("length").between(*lengths) & (F.col("qcov") >= min_cov) & (F.col("tcov") >= min_cov)
    )
    return rows.join(facts, "genome", "left")


def deepest_candidates(longest: DataFrame, facts: DataFrame, min_depth: float = 6000.0) -> DataFrame:
    """Longest targets of genomes from below ``min_depth``."""
    return longest.join(facts.where(F.col("depth_m") > min_depth), "genome")


def group_composition(rows: DataFrame, group: str, category: str, top_n: int = 8) -> DataFrame:
    """Share of each of the ``top_n`` categories and of all others within every group."""
    counts = rows.groupBy(group, category).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(category).agg(F.sum("n").alias("_t")).orderBy(F.desc("_t"), category).limit(top_n)
    named = counts.join(totals.select(category, F.lit(True).alias("_top")), category, "left")
    folded = named.groupBy(group, F.when(F.col("_top"), F.col(category)).otherwise("Other").alias(category)).agg(F.sum("n").alias("n"))
    return folded.withColumn("pct", F.col("n") * 100 / F.sum("n").over(Window.partitionBy(group)))


def metric_by_group(rows: DataFrame, group: str, metric: str) -> DataFrame:
    """n, missing, median and quartiles of a metric per group."""
    base = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(metric).isNull()).alias("n_missing"))
    quart = exact_quantiles(rows, [group], {"v": F.col(metric)}, {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return base.join(quart.select(group, *[F.col(f"v_{q}").alias(q) for q in ("p25", "median", "p75")]), group, "left")


def status_table(assignments: DataFrame) -> DataFrame:
    """Assignments and those that need review per (family, tier)."""
    return assignments.groupBy("family", "tier").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("needs_manual_review").cast("int")).alias("n_review")
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per named table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


# ---- sets and top lists ----------------------------------------------------------------


def union_with_provenance(sources: dict[str, DataFrame], key: str, lengths: DataFrame, min_length: int) -> DataFrame:
    """Ids of several named sources with the sorted list of sources, over a length floor."""
    parts = [df.select(key, F.lit(name).alias("_s")) for name, df in sources.items()]
    every = reduce(DataFrame.unionByName, parts)
    out = every.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("_s")), ",").alias("sources"))
    return out.join(lengths, key).where(F.col("length") >= min_length)


def union_distinct(rows: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """Distinct non-blank values of two columns per key."""
    parts = [rows.select(key, F.col(c).alias("value")) for c in (first, second)]
    return parts[0].union(parts[1]).where("value <> ''").distinct()


def replace_set(manifest: DataFrame, fresh: DataFrame, name: str) -> DataFrame:
    """Manifest with one named set replaced by fresh ids; running it twice changes nothing."""
    kept = manifest.where(F.col("set_name") != name)
    return kept.unionByName(fresh.select("target_id").distinct().withColumn("set_name", F.lit(name)))


def append_missing(manifest: DataFrame, fresh: DataFrame, name: str) -> DataFrame:
    """Manifest plus the ids it does not list yet under any set."""
    new = fresh.select("target_id").distinct().join(manifest, "target_id", "left_anti")
    return manifest.unionByName(new.withColumn("set_name", F.lit(name)))


def set_relations(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of both sets, their intersection and differences, and whether one holds the other."""
    left = a.select(key).distinct().withColumn("_a", F.lit(1))
    right = b.select(key).distinct().withColumn("_b", F.lit(1))
    joined = left.join(right, key, "full_outer")
    both = F.count_if((F.col("_a") == 1) & (F.col("_b") == 1))
    only_a, only_b = F.count_if(F.col("_b").isNull()), F.count_if(F.col("_a").isNull())
    return joined.agg(
        both.alias("n_both"), only_a.alias("n_only_a"), only_b.alias("n_only_b"),
        (only_a == 0).alias("a_in_b"), (only_b == 0).alias("b_in_a"),
    )


def top_with_extras(ranked: DataFrame, key: str, value: str, top_n: int, extras: Sequence[str]) -> DataFrame:
    """The ``top_n`` keys by value, then the extra ids in their own order, without repeats."""
    top = ranked.orderBy(F.desc(value), key).limit(top_n).select(key, value)
    top = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc(value), key)))
    listed = F.array(*[F.lit(e) for e in extras])
    more = ranked.where(F.col(key).isin(list(extras))).join(top.select(key), key, "left_anti")
    more = more.select(key, value, (F.lit(top_n) + F.array_position(listed, F.col(key))).cast("int").alias("position"))
    return top.select(key, "position").unionByName(more.select(key, "position"))


def ranked_list(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows by value descending, key ascending, with their rank.

    Rows are cut into ranges of the value, those of one small whole value also by the head of their key, and numbered
    range by range, so no task sorts them all.
    """
    coarse = coarse_key(F.col(value))
    kinds = dict(rows.dtypes)
    whole = kinds[value] in ("tinyint", "smallint", "int", "bigint") and kinds[key] == "string"
    small = F.abs(F.col(value)) < 1000 if whole else F.lit(False)  # a range holds one value then
    head = F.when(small, F.substring(F.col(key), 1, 2)).otherwise("")
    indexed = ordered_index(rows, [], F.struct((-coarse).alias("range"), head.alias("head")), [F.desc(value), F.col(key).asc()], "_rank")
    return indexed.withColumn("rank", (F.col("_rank") + 1).cast("int")).drop("_rank")
