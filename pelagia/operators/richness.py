"""Cluster richness: occupancy, rank–abundance, Chao2, accumulation curves and resampling nulls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia.operators.ordering import modal_value, ordered_index

# Occupancy buckets as (label, least, greatest) genomes per cluster.
OCCUPANCY_BUCKETS = [("1", 1, 1), ("2-5", 2, 5), ("6-20", 6, 20), ("21-100", 21, 100), (">100", 101, None)]


def occupancy_bucket(size: Column) -> Column:
    label = None
    for name, _, high in OCCUPANCY_BUCKETS[:-1]:
        label = (F if label is None else label).when(size <= high, F.lit(name))
    return label.otherwise(F.lit(OCCUPANCY_BUCKETS[-1][0]))


def cluster_membership(clusters: DataFrame, members: DataFrame, bad_targets: DataFrame | None = None) -> DataFrame:
    """Distinct (cluster, genome) pairs of cluster ⨝ target ⨝ genome, excluded targets left out."""
    links = members.select("target", "genome")
    if bad_targets is not None:
        links = links.join(bad_targets.select("target"), "target", "left_anti")
    named = clusters.select(F.col("member").alias("target"), F.col("rep").alias("cluster_id"))
    return links.join(named, "target").select("cluster_id", "genome").distinct()


def cluster_sizes(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_genomes"))


def occupancy_spectrum(sizes: DataFrame, size: str = "n_genomes") -> DataFrame:
    """Clusters and memberships per size bucket, each with its share."""
    out = sizes.groupBy(occupancy_bucket(F.col(size)).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_clusters"), F.sum(size).alias("n_memberships")
    )
    every = Window.partitionBy()
    return out.select(
        "bucket",
        "n_clusters",
        (F.col("n_clusters") * 100 / F.sum("n_clusters").over(every)).alias("pct_of_clusters"),
        "n_memberships",
        (F.col("n_memberships") * 100 / F.sum("n_memberships").over(every)).alias("pct_of_occupancy"),
    )


def study_profile(pairs: DataFrame, facts: DataFrame, min_genomes: int = 50, global_span: float = 180.0) -> DataFrame:
    """Per study: clusters by global size bucket, dominant habitat, mean |latitude|, longitude span."""
    sized = pairs.join(cluster_sizes(pairs).withColumn("bucket", occupancy_bucket(F.col("n_genomes"))), "cluster_id")
    placed = sized.select("cluster_id", "genome", "bucket").join(facts.select("genome", "study"), "genome")
    # A row gives its genome and its cluster; equal ones of a study merge map-side and are then counted plainly.
    entries = F.array(
        F.struct(F.lit(True).alias("is_genome"), F.col("genome").alias("value"), F.lit("").alias("bucket")),
        F.struct(F.lit(False).alias("is_genome"), F.col("cluster_id").alias("value"), F.col("bucket").alias("bucket")),
    )
    merged = placed.select("study", F.inline(entries)).distinct()
    per_bucket = [F.count_if(F.col("bucket") == name).alias(f"n_{name}") for name, _, _ in OCCUPANCY_BUCKETS]
    clusters = merged.groupBy("study").agg(
        F.count_if("is_genome").alias("n_genomes"), F.count_if(~F.col("is_genome")).alias("n_clusters"), *per_bucket
    )
    hosts = facts.join(pairs.select("genome").distinct(), "genome", "left_semi")
    places = hosts.groupBy("study").agg(
        F.avg(F.abs("lat")).alias("mean_abs_lat"), (F.max("lon") - F.min("lon")).alias("lon_span")
    )
    out = clusters.where(F.col("n_genomes") >= min_genomes).join(places, "study", "left")
    out = out.join(modal_value(hosts, ["study"], "habitat", "dominant_habitat"), "study", "left")
    return out.withColumn("lon_span", F.coalesce("lon_span", F.lit(0.0))).withColumn(
        "is_global", F.col("lon_span") >= global_span
    )


def cluster_landscape(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Per cluster: genomes, distinct rounded positions, distinct classes and the leading genus."""
    known = pairs.join(facts.select("genome", "lat", "lon", "class_name", "genus"), "genome")
    spot = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct(F.round("lat", 3), F.round("lon", 3)))
    out = known.groupBy("cluster_id").agg(
        F.count_distinct("genome").alias("n_genomes"),
        F.count_distinct(spot).alias("n_locations"),
        F.count_distinct("class_name").alias("n_classes"),
    )
    return out.join(modal_value(known, ["cluster_id"], "genus", "top_genus"), "cluster_id", "left")


def last_genome_per_target(members: DataFrame) -> DataFrame:
    """One genome per target, the last row in file order wins."""
    return members.groupBy("target").agg(F.max_by("genome", F.struct("ord", "genome")).alias("genome"))


def rank_abundance(sizes: DataFrame, size: str = "n_genomes") -> DataFrame:
    """Clusters by size with their 1-based rank.  Pieces are bounded by the number of equal sizes / hash."""
    keyed = sizes.withColumn("_neg", -F.col(size))
    indexed = ordered_index(keyed, [], F.struct("_neg", F.substring(F.md5("cluster_id"), 1, 2)), ["_neg", F.md5("cluster_id")], "_i")
    return indexed.select("cluster_id", size, (F.col("_i") + 1).alias("rank"))


def chao2(incidence: DataFrame, n_units: Column, by: Sequence[str] = ()) -> DataFrame:
    """Chao2 richness with its log-normal 95 % interval; ``incidence`` has one row per cluster with ``n``."""
    counts = incidence.groupBy(*by).agg(
        F.count(F.lit(1)).alias("observed"),
        F.count_if(F.col("n") == 1).alias("q1"),
        F.count_if(F.col("n") == 2).alias("q2"),
        F.max(n_units).alias("n_units"),
    )
    return chao2_from_counts(counts, by)


def chao2_from_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The estimate from ``observed``, ``q1``, ``q2`` and ``n_units`` columns."""
    units = F.col("n_units").cast("double")
    shrink = (units - 1) / units
    s, once, twice = (F.col(x).cast("double") for x in ("observed", "q1", "q2"))
    ratio = F.try_divide(once, twice)
    estimate = F.when(twice > 0, s + F.try_divide(shrink * once * once, 2 * twice)).otherwise(s + shrink * once * (once - 1) / 2)
    with_doubles = twice * (
        shrink / 2 * ratio * ratio + shrink * shrink * F.pow(ratio, 3) + shrink * shrink / 4 * F.pow(ratio, 4)
    )
    without = (
        shrink * once * (once - 1) / 2
        + shrink * once * F.pow(2 * once - 1, 2) / 4
        - shrink * F.try_divide(F.pow(once, 4), 4 * estimate)
    )
    out = counts.withColumn("estimate", estimate).withColumn("_var", F.when(twice > 0, with_doubles).otherwise(without))
    extra = F.col("estimate") - s
    usable = (extra > 0) & (F.col("_var") > 0)
    k = F.exp(1.96 * F.sqrt(F.log(1 + F.try_divide(F.col("_var"), extra * extra))))
    return out.select(
        *by,
        "n_units",
        "observed",
        "q1",
        "q2",
        "estimate",
        F.when(usable, s + F.try_divide(extra, k)).otherwise(s).alias("ci_low"),
        F.when(usable, s + extra * k).otherwise(F.col("estimate")).alias("ci_high"),
        F.try_divide(s * 100, F.col("estimate")).alias("pct_observed"),
    )


def richness_by_study(pairs: DataFrame, facts: DataFrame, min_genomes: int = 2) -> DataFrame:
    """Genomes, distinct clusters and dominant habitat per study."""
    placed = pairs.join(facts.select("genome", "study"), "genome")
    out = placed.groupBy("study").agg(
        F.count_distinct("genome").alias("n_genomes"), F.count_distinct("cluster_id").alias("n_clusters")
    )
    hosts = facts.join(pairs.select("genome").distinct(), "genome", "left_semi")
    return out.where(F.col("n_genomes") >= min_genomes).join(
        modal_value(hosts, ["study"], "habitat", "dominant_habitat"), "study", "left"
    )


# Fixed value: hex digits of the digest that make an order key; 60 bits stay positive in a long.
KEY_DIGITS = 15
BUCKET_SHIFT = 48  # key bits below the histogram's 4,096 buckets
LAST_KEY = (1 << 60) - 1


def order_key(unit: Column, perm: Column, seed: int) -> Column:
    """Place of a unit in a seeded order: the head of md5(unit|perm|seed) as a number.

    The same on every run, partitioning and engine. Units with equal keys share a place.
    """
    digest = F.md5(F.concat_ws("|", unit.cast("string"), perm.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, KEY_DIGITS), 16, 10).cast("long")


def permutations(units: DataFrame, unit: str, n_perm: int, seed: int) -> DataFrame:
    """(perm, unit, position): ``n_perm`` seeded orders of the distinct units, positions from 1, ties by unit.

    Positions come from key buckets, so no order is sorted in one task.
    """
    keyed = units.select(unit).distinct().select(unit, F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("perm"))
    keyed = keyed.withColumn("_h", order_key(F.col(unit), F.col("perm"), seed))
    indexed = ordered_index(keyed, ["perm"], F.shiftright("_h", BUCKET_SHIFT), ["_h", unit], "_i")
    return indexed.select("perm", unit, (F.col("_i") + 1).alias("position"))


def least_keys(pairs: DataFrame, unit: str, n_perm: int, seed: int) -> DataFrame:
    """(cluster_id, keys): for every order the least key among a cluster's units.

    That key alone says when the cluster is first met, so pairs are never multiplied by orders: one hash aggregate,
    combined before the shuffle, keeps ``n_perm`` numbers per cluster.
    """
    least = [F.min(order_key(F.col(unit), F.lit(p), seed)).alias(f"_k{p}") for p in range(n_perm)]
    return pairs.groupBy("cluster_id").agg(*least).select("cluster_id", F.array(*[f"_k{p}" for p in range(n_perm)]).alias("keys"))


def key_cuts(units: DataFrame, unit: str, weight: str, grid: DataFrame, n_perm: int, seed: int) -> DataFrame:
    """(perm, xs, cuts): for each grid point x the greatest key up to which units weigh no more than x in all.

    ``units`` has one row per unit and ``grid`` one row with a sorted array ``_xs``. Weights are summed by key bucket;
    only the buckets in which a cut falls are looked at unit by unit.
    """
    keyed = units.select(unit, weight, F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("perm"))
    keyed = keyed.select("perm", F.col(weight).alias("w"), order_key(F.col(unit), F.col("perm"), seed).alias("key"))
    keyed = keyed.withColumn("bucket", F.shiftright("key", BUCKET_SHIFT))
    along = Window.partitionBy("perm").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    filled = keyed.groupBy("perm", "bucket").agg(F.sum("w").alias("w")).withColumn("upto", F.sum("w").over(along))
    crossed = filled.withColumn("_xs", grid.scalar()).select(
        "perm", "bucket", (F.col("upto") - F.col("w")).alias("before"), F.explode(F.expr("filter(_xs, x -> x >= upto - w AND x < upto)")).alias("x")
    )
    inside = keyed.join(crossed.select("perm", "bucket").distinct(), ["perm", "bucket"]).groupBy("perm", "bucket", "key").agg(F.sum("w").alias("w"))
    in_bucket = Window.partitionBy("perm", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.select("perm", "bucket", "key", F.sum("w").over(in_bucket).alias("upto"))
    found = crossed.join(inside, ["perm", "bucket"]).groupBy("perm", "bucket", "x").agg(
        F.max(F.when(F.col("before") + F.col("upto") <= F.col("x"), F.col("key"))).alias("cut")
    )
    found = found.select("perm", "x", F.coalesce("cut", F.shiftleft("bucket", BUCKET_SHIFT) - 1).alias("cut"))
    frame = keyed.select("perm").distinct().withColumn("_xs", grid.scalar()).select("perm", F.explode("_xs").alias("x"))
    every = frame.join(found, ["perm", "x"], "left").select("perm", "x", F.coalesce("cut", F.lit(LAST_KEY)).alias("cut"))
    listed = every.groupBy("perm").agg(F.array_sort(F.collect_list(F.struct("x", "cut"))).alias("_l"))
    return listed.select("perm", F.col("_l.x").alias("xs"), F.col("_l.cut").alias("cuts"))


def seen_at(firsts: DataFrame, cuts: DataFrame) -> DataFrame:
    """(perm, x, seen): clusters whose least key is at or below the cut of each grid point."""
    located = firsts.select(F.posexplode("keys").alias("perm", "key")).join(cuts, "perm")
    per_slot = located.select("perm", F.expr("size(filter(cuts, c -> c < key))").alias("slot")).groupBy("perm", "slot").agg(F.count(F.lit(1)).alias("_n"))
    frame = cuts.select("perm", F.posexplode("xs").alias("slot", "x"))
    filled = frame.join(per_slot, ["perm", "slot"], "left").fillna(0, ["_n"])
    along = Window.partitionBy("perm").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    return filled.select("perm", "x", F.sum("_n").over(along).alias("seen"))


def even_grid(total: Column, grid: int) -> Column:
    """``grid`` evenly spaced whole numbers from 1 to ``total``, repeated ones once."""
    points = F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: F.round(1 + i * (total - 1) / (grid - 1)).cast("long"))
    return F.array_distinct(points).alias("_xs")


def accumulation_curve(pairs: DataFrame, n_perm: int, seed: int, grid: int = 50) -> DataFrame:
    """Clusters seen after the first x genomes: mean and 2.5/97.5 % band over seeded orders."""
    units = pairs.select("genome").distinct().withColumn("_one", F.lit(1).cast("long"))
    xs = units.agg(even_grid(F.count(F.lit(1)), grid))
    return _band(seen_at(least_keys(pairs, "genome", n_perm, seed), key_cuts(units, "genome", "_one", xs, n_perm, seed)))


def _band(curves: DataFrame) -> DataFrame:
    return curves.groupBy("x").agg(
        F.avg("seen").alias("mean"),
        F.percentile("seen", F.lit(0.025)).alias("low"),
        F.percentile("seen", F.lit(0.975)).alias("high"),
    )


def block_accumulation_curve(pairs: DataFrame, blocks: DataFrame, n_perm: int, seed: int, grid: int = 50) -> DataFrame:
    """Accumulation with whole blocks (studies) in random order, read at the last complete block.

    A cluster is first seen when the first block holding it is complete: a block weighs its genomes, and x genomes
    reach as far as the blocks that fit into x.
    """
    members = pairs.select("genome").distinct().join(blocks.select("genome", "block"), "genome")
    sizes = members.groupBy("block").agg(F.count(F.lit(1)).alias("_size"))
    block_pairs = pairs.join(members, "genome").select("cluster_id", "block").distinct()
    xs = sizes.agg(even_grid(F.sum("_size"), grid))
    return _band(seen_at(least_keys(block_pairs, "block", n_perm, seed), key_cuts(sizes, "block", "_size", xs, n_perm, seed)))


def expected_accumulation(pairs: DataFrame, xs: Sequence[int]) -> DataFrame:
    """Exact mean of the genome-order curve: Σ over clusters of 1 − P(no genome of the cluster in x draws).

    Clusters are collapsed to their size first, so the work is sizes × grid points.
    """
    n = pairs.agg(F.count_distinct("genome").alias("_n")).scalar()
    by_size = cluster_sizes(pairs).groupBy("n_genomes").agg(F.count(F.lit(1)).alias("_m"))
    grid = F.explode(F.array(*[F.lit(int(x)) for x in xs])).alias("x")
    table = by_size.withColumn("_n", n).select("*", grid)
    missed = F.exp(
        _log_factorial(F.col("_n") - F.col("n_genomes"))
        - _log_factorial(F.col("_n") - F.col("n_genomes") - F.col("x"))
        - _log_factorial(F.col("_n"))
        + _log_factorial(F.col("_n") - F.col("x"))
    )
    missed = F.when(F.col("_n") - F.col("n_genomes") < F.col("x"), F.lit(0.0)).otherwise(missed)
    return table.groupBy("x").agg(F.sum((1 - missed) * F.col("_m")).alias("expected"))


def _log_factorial(n: Column) -> Column:
    """ln n! by a Stirling series on n + 10, exact to about 1e-12 for every n ≥ 0."""
    x = n.cast("double") + 10
    series = (x + 0.5) * F.log(x) - x + 0.9189385332046728 + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    down = sum((F.log(n.cast("double") + i) for i in range(1, 11)), F.lit(0.0))
    return series - down


def terminal_rate(curve: DataFrame, share: float = 0.05) -> DataFrame:
    """New clusters per genome over the last ``share`` of the curve, from its two end points."""
    point = F.struct("x", "mean")
    ends = curve.agg(F.max(point).alias("_end"), F.array_sort(F.collect_list(point)).alias("_points"))
    before = F.filter("_points", lambda p: p["x"] <= F.col("_end.x") * (1 - share))
    start = F.try_element_at(before, F.lit(-1))
    rate = F.try_divide(F.col("_end.mean") - start["mean"], F.col("_end.x") - start["x"])
    return ends.select(rate.alias("terminal_rate"))


def habitat_richness_null(pairs: DataFrame, facts: DataFrame, n_perm: int, seed: int, min_genomes: int = 20) -> DataFrame:
    """Distinct clusters of each habitat against seeded draws of the same number of genomes.

    One order per permutation serves every habitat: the first n genomes of a random order
    are a random draw of n.
    """
    hosts = facts.join(pairs.select("genome").distinct(), "genome", "left_semi").select("genome", "habitat")
    observed = pairs.join(hosts, "genome").groupBy("habitat").agg(
        F.count_distinct("cluster_id").alias("observed"), F.count_distinct("genome").alias("n_genomes")
    )
    observed = observed.where(F.col("n_genomes") >= min_genomes)
    units = pairs.select("genome").distinct().withColumn("_one", F.lit(1).cast("long"))
    sizes = observed.agg(F.array_sort(F.collect_set("n_genomes")).alias("_xs"))
    drawn = seen_at(least_keys(pairs, "genome", n_perm, seed), key_cuts(units, "genome", "_one", sizes, n_perm, seed))
    null = observed.join(drawn, F.col("n_genomes") == F.col("x"))
    return null.groupBy("habitat", "observed", "n_genomes").agg(
        F.avg("seen").alias("expected"),
        F.percentile("seen", F.lit(0.025)).alias("low"),
        F.percentile("seen", F.lit(0.975)).alias("high"),
        (F.max("observed") / F.avg("seen")).alias("ratio"),
        ((F.count_if(F.col("seen") <= F.col("observed")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_low"),
    )


def rare_cluster_share(pairs: DataFrame, facts: DataFrame, rare_max: int = 5) -> DataFrame:
    """Share of a habitat's clusters that are rare overall, and its log2 ratio to the overall share."""
    sizes = cluster_sizes(pairs).withColumn("_rare", F.col("n_genomes") <= rare_max)
    overall = sizes.agg((F.count_if("_rare") / F.count(F.lit(1))).alias("_all"))
    placed = pairs.join(facts.select("genome", "habitat"), "genome").select("habitat", "cluster_id").distinct()
    out = placed.join(sizes.select("cluster_id", "_rare"), "cluster_id").groupBy("habitat").agg(
        F.count(F.lit(1)).alias("n_clusters"), (F.count_if("_rare") / F.count(F.lit(1))).alias("rare_share")
    )
    return out.withColumn("_all", overall.scalar()).select(
        "habitat", "n_clusters", "rare_share", F.log2(F.col("rare_share") / F.col("_all")).alias("log2_enrichment")
    )


def stratified_sample(rows: DataFrame, stratum: str, key: str, size: int, seed: int) -> DataFrame:
    """Proportional sample of about ``size`` rows, at least one per stratum, the same on every run.

    Rows are ordered by a seeded digest; positions are found per digest bucket.
    """
    keyed = rows.withColumn("_h", order_key(F.col(key), F.lit(0), seed))
    indexed = ordered_index(keyed, [stratum], F.shiftright("_h", BUCKET_SHIFT), ["_h", key], "_i", total="_n")
    counts = rows.agg(F.count(F.lit(1)).alias("_all"))
    quota = F.greatest(F.lit(1), F.round(F.lit(size) * F.col("_n") / F.col("_all")))
    picked = indexed.withColumn("_all", counts.scalar()).where(F.col("_i") < quota)
    return picked.drop("_h", "_i", "_n", "_all")
