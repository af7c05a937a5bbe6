"""Site × cluster communities: sparse matrix, dissimilarities, ordination and the Mantel test."""

from __future__ import annotations

from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia.functions.geo import ocean_basin
from pelagia.operators.ordering import block_pairs, first_by
from pelagia.operators.richness import permutations
from pelagia.session import cut_lineage


def site_cluster_counts(
    rows: DataFrame, min_richness: int = 3, max_sites: int | None = None, meta: tuple[str, ...] = ("study", "habitat")
) -> tuple[DataFrame, DataFrame]:
    """(site, cluster, n) of the qualifying sites, and one metadata row per site.

    Rows are counted, not targets.  Sites need a position and ``min_richness`` distinct
    clusters; ``max_sites``, if given, keeps the richest, ties by site name.
    """
    placed = rows.where("sample_id <> '' AND lat IS NOT NULL AND lon IS NOT NULL")
    counts = placed.groupBy(F.col("sample_id").alias("site"), "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    # Read again for the richness, the cap and every distance, so it is written once.
    counts = cut_lineage(counts)
    richness = counts.groupBy("site").agg(F.count(F.lit(1)).alias("richness")).where(F.col("richness") >= min_richness)
    if max_sites is not None:
        richness = richness.orderBy(F.desc("richness"), "site").limit(max_sites)
    kept = counts.join(richness.select("site"), "site", "left_semi")
    first = first_by(placed.withColumnRenamed("sample_id", "site"), ["site"], ["ord"], ["lat", "lon", *meta])
    sites = richness.join(first, "site").withColumn("ocean_basin", ocean_basin(F.col("lat"), F.col("lon")))
    return kept, sites


def community_distances(counts: DataFrame) -> DataFrame:
    """Bray–Curtis and Jaccard dissimilarity of every pair of sites (a < b) that share a cluster.

    All other pairs are at distance 1 and are not listed. Clusters of many sites are joined block by block, and the
    minima are summed map-side.
    """
    totals = counts.groupBy("site").agg(F.sum("n").alias("_s"), F.count(F.lit(1)).alias("_k"))
    met = block_pairs(counts.select("site", "cluster_id", "n"), "cluster_id", "site")
    shared = met.groupBy("site_a", "site_b").agg(F.sum(F.least("n_a", "n_b")).alias("_min"), F.count(F.lit(1)).alias("_both"))
    ta = totals.select(F.col("site").alias("site_a"), F.col("_s").alias("_sa"), F.col("_k").alias("_ka"))
    tb = totals.select(F.col("site").alias("site_b"), F.col("_s").alias("_sb"), F.col("_k").alias("_kb"))
    joined = shared.join(ta, "site_a").join(tb, "site_b")
    return joined.select(
        "site_a",
        "site_b",
        (1 - 2 * F.col("_min") / (F.col("_sa") + F.col("_sb"))).alias("bray_curtis"),
        (1 - F.col("_both") / (F.col("_ka") + F.col("_kb") - F.col("_both"))).alias("jaccard"),
    )


def complete_pairs(distances: DataFrame, sites: DataFrame, columns: tuple[str, ...] = ("bray_curtis", "jaccard")) -> DataFrame:
    """All pairs of a capped site list; pairs that share nothing are at distance 1."""
    listed = sites.agg(F.array_sort(F.collect_list("site")).alias("_all"))
    pairs = sites.withColumn("_all", listed.scalar()).select(
        F.col("site").alias("site_a"), F.explode(F.filter("_all", lambda s: s > F.col("site"))).alias("site_b")
    )
    return pairs.join(distances, ["site_a", "site_b"], "left").fillna(1.0, list(columns))


def _both_ways(pairs: DataFrame, value: str) -> DataFrame:
    forward = pairs.select("site_a", "site_b", F.col(value).alias("d"))
    return forward.unionByName(forward.select(F.col("site_b").alias("site_a"), F.col("site_a").alias("site_b"), "d"))


def gower_centred(pairs: DataFrame, value: str) -> DataFrame:
    """Double-centred −½d² as (row, col, b), from row and grand means; the diagonal is included."""
    both = _both_ways(cut_lineage(pairs), value)
    square = both.select("site_a", "site_b", (F.col("d") * F.col("d")).alias("sq"))
    own = square.select("site_a").unionByName(square.select(F.col("site_b").alias("site_a"))).distinct()
    full = square.unionByName(own.select("site_a", F.col("site_a").alias("site_b"), F.lit(0.0).alias("sq")))
    means = full.groupBy("site_a").agg(F.avg("sq").alias("_m"))
    grand = means.agg(F.avg("_m").alias("_g"))
    out = full.join(means.withColumnRenamed("_m", "_ma"), "site_a").join(
        means.select(F.col("site_a").alias("site_b"), F.col("_m").alias("_mb")), "site_b"
    )
    return out.withColumn("_g", grand.scalar()).select(
        "site_a", "site_b", (-0.5 * (F.col("sq") - F.col("_ma") - F.col("_mb") + F.col("_g"))).alias("b")
    )


def principal_coordinates(pairs: DataFrame, value: str, n_components: int = 2) -> DataFrame:
    """PCoA coordinates and the share of the positive eigenvalues per axis.

    The centred matrix has one row per site of the capped list; its singular values come
    from a distributed row matrix.  An eigenvalue is the singular value signed by u·v;
    only positive ones count.  Axis signs make the largest coordinate positive.
    """
    spark = pairs.sparkSession
    centred = cut_lineage(gower_centred(pairs, value))
    sites = centred.select(F.col("site_a").alias("site")).distinct()
    index = sites.withColumn("i", F.row_number().over(Window.orderBy("site")) - 1)
    indexed = centred.join(index.select(F.col("site").alias("site_a"), F.col("i").alias("_i")), "site_a").join(
        index.select(F.col("site").alias("site_b"), F.col("i").alias("_j")), "site_b"
    )
    rows = indexed.groupBy("_i").agg(F.array_sort(F.collect_list(F.struct("_j", "b"))).alias("_r"))
    rows = rows.select("_i", F.transform("_r", lambda e: e["b"]).alias("_v"))
    matrix = IndexedRowMatrix(rows.rdd.map(lambda r: IndexedRow(r["_i"], Vectors.dense(r["_v"]))))
    svd = matrix.computeSVD(matrix.numCols(), computeU=True, rCond=1e-12)
    values, v = svd.s.toArray(), svd.V.toArray()
    u_rows = spark.createDataFrame(svd.U.rows.map(lambda r: (int(r.index), [float(x) for x in r.vector.toArray()])), "i long, u array<double>")
    # The sign of an eigenvalue is that of u·v, summed over the sites.
    v_frame = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(v.shape[0])], "i long, v array<double>")
    dots = u_rows.join(v_frame, "i").select(F.posexplode(F.zip_with("u", "v", lambda a, b: a * b)).alias("c", "p"))
    signs = {r["c"]: r["s"] for r in dots.groupBy("c").agg(F.sum("p").alias("s")).collect()}
    eigen = [float(s) if signs[c] > 0 else -float(s) for c, s in enumerate(values)]
    order = [c for c in sorted(range(len(eigen)), key=lambda c: -eigen[c]) if eigen[c] > 1e-10]
    positive = sum(eigen[c] for c in order)
    out = v_frame.join(index, "i").select("site", "v")
    axes = []
    for n in range(n_components):
        if n < len(order):
            c = order[n]
            flip = 1.0 if v[abs(v[:, c]).argmax(), c] >= 0 else -1.0
            axes.append((F.col("v")[c] * (flip * eigen[c] ** 0.5)).alias(f"axis{n + 1}"))
            axes.append(F.lit(eigen[c] / positive).alias(f"share{n + 1}"))
        else:
            axes += [F.lit(0.0).alias(f"axis{n + 1}"), F.lit(0.0).alias(f"share{n + 1}")]
    return out.select("site", *axes)


def _pair_sums(pairs: DataFrame, sites: DataFrame) -> DataFrame:
    """One row of sums over the listed pairs (s, t): pairs in all, products, and whether s or t is one value throughout."""
    n = sites.agg(F.count(F.lit(1)).cast("double").alias("n"))
    products = {"s": F.col("s"), "t": F.col("t"), "ss": F.col("s") * F.col("s"), "tt": F.col("t") * F.col("t"), "st": F.col("s") * F.col("t")}
    sums = pairs.agg(
        F.count(F.lit(1)).alias("_listed"),
        *[F.coalesce(F.sum(v), F.lit(0.0)).alias(f"_{k}") for k, v in products.items()],
        *[f(c).alias(f"_{name}_{c}") for c in "st" for name, f in (("low", F.min), ("high", F.max))],
    )
    known = sums.withColumn("_n", n.scalar()).withColumn("_m", F.col("_n") * (F.col("_n") - 1) / 2)
    zero = F.when(F.col("_listed") < F.col("_m"), F.lit(0.0))  # of the pairs that are not listed
    flat = [F.coalesce(F.least(f"_low_{c}", zero) == F.greatest(f"_high_{c}", zero), F.lit(True)) for c in "st"]
    return known.withColumn("_flat", flat[0] | flat[1])


def _pearson(product: Column, flat: float | None) -> Column:
    """r of a row of :func:`_pair_sums` with this sum of products; ``flat`` where a distance does not vary, NULL without pairs."""
    s, t, m = F.col("_s"), F.col("_t"), F.col("_m")
    spread = F.sqrt((m * F.col("_ss") - s * s) * (m * F.col("_tt") - t * t))
    constant = F.when(m > 0, F.lit(flat).cast("double"))
    return F.when(F.col("_flat"), constant).otherwise(F.try_divide(m * product - s * t, spread))


def _similarities(shared: DataFrame, a: str, b: str) -> DataFrame:
    return shared.select("site_a", "site_b", (1 - F.col(a)).alias("s"), (1 - F.col(b)).alias("t"))


def mantel_statistic(shared: DataFrame, sites: DataFrame, a: str, b: str, flat: float | None = None) -> DataFrame:
    """Pearson r of two distances over all pairs of sites, one row; arguments as in :func:`mantel_test`."""
    known = _pair_sums(_similarities(shared, a, b), sites.select("site").distinct())
    return known.select(_pearson(F.col("_st"), flat).alias("r"))


def mantel_test(
    shared: DataFrame, sites: DataFrame, a: str, b: str, n_perm: int = 999, seed: int = 0, flat: float | None = None
) -> DataFrame:
    """Pearson r of two distances over all pairs of sites, and its two-sided, add-one permutation p.

    ``shared`` lists the pairs (site_a < site_b) with a distance below 1; every other pair of ``sites`` is at 1 in both.
    With s = 1 - d the rest are zeros, means and variances are sums over the listed pairs, and relabelling the sites of
    one distance changes none of them: a permutation only needs the sum of products of pairs listed on both sides, so
    the full table of pairs is never made. Site i becomes the site that stands in the first order where i stands in the
    permutation's. Where a distance does not vary, r is ``flat``: None makes r and p null; with NaN, which equals
    itself, every permutation counts and p is 1.
    """
    pairs = cut_lineage(_similarities(shared, a, b))
    names = sites.select("site").distinct()
    known = _pair_sums(pairs, names)
    orders = cut_lineage(permutations(names, "site", n_perm + 1, seed))
    start = orders.where("perm = 0").select(F.col("site").alias("to"), "position")
    moved = orders.where("perm > 0").join(start, "position").select("perm", "site", "to")
    first = moved.select("perm", F.col("site").alias("site_a"), F.col("to").alias("_ta"))
    second = moved.select("perm", F.col("site").alias("site_b"), F.col("to").alias("_tb"))
    opened = pairs.select("site_a", "site_b", "s").join(first, "site_a").join(second, ["perm", "site_b"])
    keyed = opened.select("perm", "s", F.least("_ta", "_tb").alias("site_a"), F.greatest("_ta", "_tb").alias("site_b"))
    met = keyed.join(pairs.select("site_a", "site_b", "t"), ["site_a", "site_b"]).groupBy("perm").agg(F.sum(F.col("s") * F.col("t")).alias("_p"))
    every = orders.where("perm > 0").select("perm").distinct().join(met, "perm", "left").fillna(0.0, ["_p"])
    null = every.join(F.broadcast(known)).select(_pearson(F.col("_st"), flat).alias("r"), _pearson(F.col("_p"), flat).alias("rp"))  # one row of sums
    return null.groupBy("r").agg(
        F.when(F.col("r").isNotNull(), (F.count_if(F.abs("rp") >= F.abs("r")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"),
        F.count(F.lit(1)).alias("n_permutations"),
    )
