"""Stratified 2×2 tests, rank tests, multiple-testing correction and group summaries.

Everything that grows with the data is a grouped count in Spark; tail probabilities
are taken afterwards on one row per test.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia.functions.tails import chi2_tail_1df, fisher_exact_p, normal_two_sided
from pelagia.operators.ordering import coarse_key, cumulative_counts, exact_quantiles, null_safe_join
from pelagia.session import cut_lineage


def two_by_two_by_stratum(rows: DataFrame, group: str, stratum: str, positive: Column) -> DataFrame:
    """Counts inside and outside each group, per stratum: a,b inside with/without, c,d outside.

    Only strata that occur inside the group are listed: a stratum without inside rows
    adds nothing to any pooled estimate, and outside counts come from stratum totals,
    so no group × stratum grid is built.
    """
    inside = (
        rows.where(F.col(stratum).isNotNull())
        .groupBy(group, stratum)
        .agg(F.count_if(positive).alias("a"), F.count_if(~positive).alias("b"))
    )
    totals = inside.groupBy(stratum).agg(F.sum("a").alias("_pos"), F.sum("b").alias("_neg"))
    return inside.join(totals, stratum).select(
        group, stratum, "a", "b", (F.col("_pos") - F.col("a")).alias("c"), (F.col("_neg") - F.col("b")).alias("d")
    )


def mantel_haenszel(tables: DataFrame, by: Sequence[str], min_stratum_n: int = 1, z: float = 1.96, with_p: bool = True) -> DataFrame:
    """Pooled odds ratio, CMH statistic (no continuity correction), RBG interval and strata used."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    used = (n > min_stratum_n) & (a + b > 0) & (c + d > 0)
    expected = (a + b) * (a + c) / n
    variance = F.try_divide((a + b) * (c + d) * (a + c) * (b + d), n * n * (n - 1))
    r, s, p, q = a * d / n, b * c / n, (a + d) / n, (b + c) / n

    def total(value: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(used, value)), F.lit(0.0)).alias(name)

    sums = tables.groupBy(*by).agg(
        F.count_if(used).alias("n_strata_used"),
        total(a, "_a"), total(expected, "_e"), total(variance, "_v"),
        total(r, "_r"), total(s, "_s"), total(p * r, "_pr"), total(p * s + q * r, "_pq"), total(q * s, "_qs"),
    )
    has_test = (F.col("_s") > 0) & (F.col("_v") > 0)
    has_ci = (F.col("_r") > 0) & (F.col("_s") > 0)
    log_var = (
        F.try_divide(F.col("_pr"), 2 * F.col("_r") * F.col("_r"))
        + F.try_divide(F.col("_pq"), 2 * F.col("_r") * F.col("_s"))
        + F.try_divide(F.col("_qs"), 2 * F.col("_s") * F.col("_s"))
    )
    ratio = F.try_divide("_r", "_s")
    half = z * F.sqrt(log_var)
    out = sums.select(
        *by,
        F.when(has_test, ratio).alias("odds_ratio"),
        F.when(has_test, F.try_divide(F.pow(F.abs(F.col("_a") - F.col("_e")), 2), F.col("_v"))).alias("cmh_chi2"),
        F.when(has_ci, ratio * F.exp(-half)).alias("ci_low"),
        F.when(has_ci, ratio * F.exp(half)).alias("ci_high"),
        "n_strata_used",
    )
    return out.withColumn("cmh_p", chi2_tail_1df("cmh_chi2")) if with_p else out


def raw_two_by_two(rows: DataFrame, group: str, positive: Column) -> DataFrame:
    """Unstratified a,b,c,d per group against all other rows."""
    inside = rows.groupBy(group).agg(F.count_if(positive).alias("a"), F.count_if(~positive).alias("b"))
    all_a, all_b = rows.agg(F.count_if(positive)).scalar(), rows.agg(F.count_if(~positive)).scalar()
    return inside.select(group, "a", "b", (all_a - F.col("a")).alias("c"), (all_b - F.col("b")).alias("d"))


def fisher_exact(tables: DataFrame) -> DataFrame:
    """Sample odds ratio and two-sided exact p for every a,b,c,d row."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    ratio = F.try_divide(a * d, b * c)
    return tables.withColumn("fisher_or", ratio).withColumn("fisher_p", fisher_exact_p("a", "b", "c", "d"))


def benjamini_hochberg(tests: DataFrame, p: str, alpha: float = 0.05, name: str = "q_value") -> DataFrame:
    """BH q-values and the Bonferroni bound over all tests (one row per test, NULL p counts as one).

    Equal p-values are collapsed first and ranked by counts. The running minimum from the greatest p down is taken
    within ranges of p, after the least value of every range has been passed down through the ranges, whose number is
    bounded by three significant digits and the exponents of a double.
    """
    value = F.coalesce(F.col(p), F.lit(1.0))
    tests = tests.withColumn("_p", value)
    ranked = cumulative_counts(tests, [], "_p")
    scaled = ranked.select("_p", "n_total", (F.col("_p") * F.col("n_total") / (F.col("n_before") + F.col("n"))).alias("_scaled"), coarse_key(F.col("_p")).alias("_range"))
    above = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = scaled.groupBy("_range").agg(F.min("_scaled").alias("_least"))
    ranges = ranges.select("_range", F.min("_least").over(above).alias("_above"))
    from_top = Window.partitionBy("_range").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    q = scaled.withColumn("_within", F.min("_scaled").over(from_top)).join(ranges, "_range").select(
        "_p", F.least(F.lit(1.0), "_within", "_above").alias(name), (F.lit(alpha) / F.col("n_total")).alias("bonferroni_bound")
    )
    return tests.join(q, "_p").drop("_p")


def standardized_rate(tables: DataFrame, group: str, base_rate: Column) -> DataFrame:
    """Observed share and the share expected if only the strata mix differed.

    Strata unseen outside the group fall back to ``base_rate``.
    """
    inside, outside = F.col("a") + F.col("b"), F.col("c") + F.col("d")
    rate = F.coalesce(F.try_divide(F.col("c"), outside), base_rate)
    return tables.groupBy(group).agg(
        (F.sum("a") * 100 / F.sum(inside)).alias("observed_pct"),
        (F.sum(inside * rate) * 100 / F.sum(inside)).alias("expected_pct"),
        F.sum(inside).alias("n_inside"),
    )


def log2_enrichment(rows: DataFrame, group: str, flags: dict[str, Column]) -> DataFrame:
    """log2 of the smoothed share in a group over the smoothed share of all rows, per flag."""
    marked = rows.select(
        group, F.inline(F.array(*[F.struct(F.lit(k).alias("flag"), v.alias("_on")) for k, v in flags.items()]))
    )
    counts = marked.groupBy(group, "flag").agg(F.count(F.lit(1)).alias("n"), F.count_if("_on").alias("n_on"))
    over_all = Window.partitionBy("flag")
    base = (F.sum("n_on").over(over_all) + 0.5) / (F.sum("n").over(over_all) + 1)
    return counts.withColumn("base_rate", base).withColumn(
        "log2_enrichment", F.log2(((F.col("n_on") + 0.5) / (F.col("n") + 1)) / F.col("base_rate"))
    )


def mann_whitney(rows: DataFrame, value: str, first_group: Column, by: Sequence[str] = (), with_p: bool = True) -> DataFrame:
    """Rank-sum test of two groups with tie-averaged ranks: z and the share u/(n1·n2).

    Works on counts per distinct value, so ties are collapsed before any ordering.
    """
    by = list(by)
    kept = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), first_group.alias("_first"))
    ranks = cumulative_counts(kept, by, "_v")
    firsts = kept.where("_first").groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n1"))
    joined = null_safe_join(ranks, firsts, [*by, "_v"], "left").fillna(0, ["_n1"])
    n, n1 = F.col("n").cast("double"), F.col("_n1").cast("double")
    mid_rank = F.col("n_before") + (n + 1) / 2
    sums = joined.groupBy(*by).agg(
        F.sum(mid_rank * n1).alias("_ranks"),
        F.sum(n1).alias("_a"),
        F.max("n_total").cast("double").alias("_n"),
        F.sum(n * n * n - n).alias("_ties"),
    )
    a, total = F.col("_a"), F.col("_n")
    b = total - a
    u = F.col("_ranks") - a * (a + 1) / 2
    sd = F.sqrt(a * b / 12 * ((total + 1) - F.try_divide(F.col("_ties"), total * (total - 1))))
    out = sums.select(
        *by,
        a.cast("long").alias("n1"),
        b.cast("long").alias("n2"),
        u.alias("u1"),
        F.try_divide(u - a * b / 2, sd).alias("z"),
        F.try_divide(u, a * b).alias("effect"),
    )
    return out.withColumn("p_value", normal_two_sided("z")) if with_p else out


def group_summary(rows: DataFrame, group: str, value: str, cuts: Sequence[float] = (50, 70, 90)) -> DataFrame:
    """n, n with a value, median, exclusive quartiles, mean and shares at or over each cut."""
    rows = cut_lineage(rows.select(group, value))  # read by the plain aggregates and twice by the quantiles
    known = F.col(value).isNotNull()
    base = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(value).alias("n_with_value"),
        F.avg(value).alias("mean"),
        *[
            F.try_divide(F.count_if(known & (F.col(value) >= c)) * 100, F.count(value)).alias(f"pct_ge_{c:g}")
            for c in cuts
        ],
    )
    quart = exact_quantiles(rows, [group], {"v": F.col(value)}, {"q1": 0.25, "median": 0.5, "q3": 0.75}, "exclusive")
    return base.join(quart.select(group, F.col("v_q1").alias("q1"), F.col("v_median").alias("median"), F.col("v_q3").alias("q3")), group, "left")
