"""Registered queries: stratified tests, rank tests, richness and resampling."""

from __future__ import annotations

from pelagia.operators import richness, stats
from pelagia.plans.common import F, rel, rounded, table
from pelagia.plans.ecology_plans import POS_SQL, positives
from pelagia.plans.registry import query

MARK_SQL = f"""{POS_SQL}, g AS (SELECT f.*, p.genome IS NOT NULL AS hit FROM facts f LEFT JOIN pos p ON p.genome = f.genome)"""
TBL_SQL = f"""{MARK_SQL}, ins AS (SELECT habitat, phylum, count(*) FILTER (hit) AS a, count(*) FILTER (NOT hit) AS b FROM g GROUP BY ALL),
    tot AS (SELECT phylum, sum(a) AS pa, sum(b) AS pb FROM ins GROUP BY 1),
    t AS (SELECT habitat, phylum, a, b, CAST(pa - a AS BIGINT) AS c, CAST(pb - b AS BIGINT) AS d FROM ins JOIN tot USING (phylum))"""
MH_SQL = """mh AS (SELECT {by}, count(*) FILTER (ok) AS n_strata_used, sum(a*1.0) FILTER (ok) AS sa, sum(e) FILTER (ok) AS se,
    sum(v) FILTER (ok) AS sv, sum(r) FILTER (ok) AS sr, sum(s) FILTER (ok) AS ss, sum(p*r) FILTER (ok) AS pr,
    sum(p*s+q*r) FILTER (ok) AS pq, sum(q*s) FILTER (ok) AS qs
    FROM (SELECT *, (a+b)*(a+c)::DOUBLE/n AS e, (a+b)::DOUBLE*(c+d)*(a+c)*(b+d)/(n*n*(n-1)) AS v, a::DOUBLE*d/n AS r,
            b::DOUBLE*c/n AS s, (a+d)::DOUBLE/n AS p, (b+c)::DOUBLE/n AS q, n > 1 AND a+b > 0 AND c+d > 0 AS ok
          FROM (SELECT *, (a+b+c+d)::DOUBLE AS n FROM {src})) GROUP BY {by})"""


def marked(spark, sf):
    hit = positives(spark, sf).withColumn("_h", F.lit(True))
    return rel(spark, sf, "facts").join(hit, "genome", "left").withColumn("hit", F.coalesce("_h", F.lit(False))).drop("_h")


@query("ag30_two_by_two_by_stratum", f"WITH {TBL_SQL} SELECT * FROM t", ("annotated",))
def ag30(spark, sf):
    return stats.two_by_two_by_stratum(marked(spark, sf), "habitat", "phylum", F.col("hit"))


@query(
    "ag31_mantel_haenszel",
    f"""WITH {TBL_SQL}, {MH_SQL.format(by='habitat', src='t')} SELECT habitat, n_strata_used, round(sr/ss, 6) AS odds_ratio,
        round(pow(abs(sa-se), 2)/sv, 6) AS cmh_chi2 FROM mh""",
    ("annotated",),
)
def ag31(spark, sf):
    tables = stats.two_by_two_by_stratum(marked(spark, sf), "habitat", "phylum", F.col("hit"))
    out = stats.mantel_haenszel(tables, ["habitat"], with_p=False).drop("ci_low", "ci_high")
    return rounded(out, "odds_ratio", "cmh_chi2")


@query(
    "ag32_mantel_haenszel_interval",
    f"""WITH {TBL_SQL}, {MH_SQL.format(by='habitat', src='t')}, w AS (SELECT *, 1.96*sqrt(pr/(2*sr*sr) + pq/(2*sr*ss) + qs/(2*ss*ss)) AS h FROM mh)
        SELECT habitat, round(sr/ss*exp(-h), 6) AS ci_low, round(sr/ss*exp(h), 6) AS ci_high FROM w""",
    ("annotated",),
)
def ag32(spark, sf):
    tables = stats.two_by_two_by_stratum(marked(spark, sf), "habitat", "phylum", F.col("hit"))
    out = stats.mantel_haenszel(tables, ["habitat"], with_p=False).select("habitat", "ci_low", "ci_high")
    return rounded(out, "ci_low", "ci_high")


@query("ag31_mantel_haenszel_with_p")
def ag31_p(spark, sf):
    tables = stats.two_by_two_by_stratum(marked(spark, sf), "habitat", "phylum", F.col("hit"))
    return stats.mantel_haenszel(tables, ["habitat"])


@query(
    "ag33_fisher_exact",
    f"""WITH {MARK_SQL}, h AS (SELECT habitat, count(*) FILTER (hit) AS a, count(*) FILTER (NOT hit) AS b FROM g GROUP BY 1),
        t AS (SELECT habitat, a, b, CAST(sum(a) OVER () - a AS BIGINT) AS c, CAST(sum(b) OVER () - b AS BIGINT) AS d FROM h),
        k AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS k FROM t),
        w AS (SELECT *, -(lgamma(k + 1) + lgamma(a + b - k + 1) + lgamma(a + c - k + 1) + lgamma(d - a + k + 1)) AS w,
                     -(lgamma(a + 1) + lgamma(b + 1) + lgamma(c + 1) + lgamma(d + 1)) AS seen FROM k),
        m AS (SELECT *, max(w) OVER (PARTITION BY habitat) AS top FROM w)
        SELECT habitat, a, b, c, d, round(any_value(a::DOUBLE * d / nullif(b::DOUBLE * c, 0)), 6) AS fisher_or,
               round(sum(exp(w - top)) FILTER (w <= seen + 1e-7) / sum(exp(w - top)), 6) AS fisher_p FROM m GROUP BY habitat, a, b, c, d""",
    ("annotated", "facts"),
)
def ag33(spark, sf):
    return rounded(stats.fisher_exact(stats.raw_two_by_two(marked(spark, sf), "habitat", F.col("hit"))), "fisher_or", "fisher_p")


@query(
    "ag33_raw_two_by_two",
    f"""WITH {MARK_SQL}, h AS (SELECT habitat, count(*) FILTER (hit) AS a, count(*) FILTER (NOT hit) AS b FROM g GROUP BY 1)
        SELECT habitat, a, b, CAST(sum(a) OVER () - a AS BIGINT) AS c, CAST(sum(b) OVER () - b AS BIGINT) AS d FROM h""",
    ("annotated",),
)
def ag33_tables(spark, sf):
    return stats.raw_two_by_two(marked(spark, sf), "habitat", F.col("hit"))


@query(
    "ag34_benjamini_hochberg",
    """WITH p AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE ((doc_id * 7919) % 1000) / 1000.0::DOUBLE END AS p FROM documents),
       r AS (SELECT doc_id, p, coalesce(p, 1.0) AS pp, count(*) OVER () AS n,
                    count(*) OVER (ORDER BY coalesce(p, 1.0) RANGE UNBOUNDED PRECEDING) AS k FROM p)
       SELECT doc_id, p, round(least(1.0, min(pp*n/k) OVER (ORDER BY pp DESC RANGE UNBOUNDED PRECEDING)), 9) AS q_value,
              round(0.05/n, 12) AS bonferroni_bound FROM r""",
)
def ag34(spark, sf):
    tests = table(spark, sf, "documents").selectExpr(
        "doc_id", "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST((doc_id * 7919) % 1000 AS DOUBLE) / 1000 END AS p"
    )
    out = stats.benjamini_hochberg(tests, "p")
    return rounded(rounded(out, "q_value", digits=9), "bonferroni_bound", digits=12)


@query(
    "ag35_standardized_rate",
    f"""WITH {TBL_SQL}, base AS (SELECT avg(hit::INT) AS r FROM g)
        SELECT habitat, round(100.0*sum(a)/sum(a+b), 6) AS observed_pct,
               round(100.0*sum((a+b) * CASE WHEN c+d > 0 THEN c::DOUBLE/(c+d) ELSE r END)/sum(a+b), 6) AS expected_pct,
               CAST(sum(a+b) AS BIGINT) AS n_inside FROM t, base GROUP BY habitat""",
    ("annotated",),
)
def ag35(spark, sf):
    rows = marked(spark, sf)
    tables = stats.two_by_two_by_stratum(rows, "habitat", "phylum", F.col("hit"))
    base = rows.agg(F.avg(F.col("hit").cast("int")).alias("r"))
    out = stats.standardized_rate(tables.withColumn("_base", base.scalar()), "habitat", F.col("_base"))
    return rounded(out, "observed_pct", "expected_pct")


@query(
    "ag36_log2_enrichment",
    f"""WITH {MARK_SQL}, l AS (SELECT habitat, 'hit' AS flag, hit AS o FROM g UNION ALL SELECT habitat, 'deep', coalesce(depth_m > 4000, false) FROM g),
        c AS (SELECT habitat, flag, count(*) AS n, count(*) FILTER (o) AS n_on FROM l GROUP BY ALL),
        b AS (SELECT flag, (sum(n_on)+0.5)/(sum(n)+1) AS base_rate FROM c GROUP BY flag)
        SELECT habitat, flag, n, n_on, round(base_rate, 6) AS base_rate, round(log2(((n_on+0.5)/(n+1))/base_rate), 6) AS log2_enrichment
        FROM c JOIN b USING (flag)""",
    ("annotated",),
)
def ag36(spark, sf):
    flags = {"hit": F.col("hit"), "deep": F.coalesce(F.col("depth_m") > 4000, F.lit(False))}
    out = stats.log2_enrichment(marked(spark, sf), "habitat", flags)
    return rounded(out.withColumn("base_rate", F.col("base_rate").cast("double")), "base_rate", "log2_enrichment")


@query(
    "ag37_mann_whitney",
    """WITH o AS (SELECT o_orderstatus AS s, o_orderpriority = '1-URGENT' AS f, round(o_totalprice, -3) AS v FROM orders),
       r AS (SELECT s, f, v, rank() OVER (PARTITION BY s ORDER BY v) + (count(*) OVER (PARTITION BY s, v) - 1)/2.0 AS rk,
                    count(*) OVER (PARTITION BY s, v) AS t FROM o),
       a AS (SELECT s, sum(rk) FILTER (f)::DOUBLE AS ra, count(*) FILTER (f)::DOUBLE AS n1, count(*) FILTER (NOT f)::DOUBLE AS n2,
                    sum((t::DOUBLE*t*t - t)/t) AS ties FROM r GROUP BY s)
       SELECT s AS o_orderstatus, n1::BIGINT AS n1, n2::BIGINT AS n2, ra - n1*(n1+1)/2 AS u1,
              round((ra - n1*(n1+1)/2 - n1*n2/2)/sqrt(n1*n2/12*((n1+n2+1) - ties/((n1+n2)*(n1+n2-1)))), 6) AS z,
              round((ra - n1*(n1+1)/2)/(n1*n2), 6) AS effect FROM a""",
)
def ag37(spark, sf):
    rows = table(spark, sf, "orders").withColumn("price", F.round("o_totalprice", -3))
    out = stats.mann_whitney(rows, "price", F.col("o_orderpriority") == "1-URGENT", ["o_orderstatus"], with_p=False)
    return rounded(out, "z", "effect")


def _exclusive(i: int) -> str:
    return f"""(list_sort(l)[greatest(1, least(({i}*(m+1))//4, m-1))] * (4 - ({i}*(m+1) - 4*greatest(1, least(({i}*(m+1))//4, m-1))))
        + list_sort(l)[greatest(1, least(({i}*(m+1))//4, m-1)) + 1] * ({i}*(m+1) - 4*greatest(1, least(({i}*(m+1))//4, m-1)))) / 4.0"""


@query(
    "ag38_group_summary",
    f"""WITH {MARK_SQL}, s AS (SELECT hit, count(*) AS n, count(completeness) AS m, avg(completeness) AS mean,
          list(completeness) FILTER (completeness IS NOT NULL) AS l, 100.0*count(*) FILTER (completeness >= 50)/count(completeness) AS p5,
          100.0*count(*) FILTER (completeness >= 70)/count(completeness) AS p7,
          100.0*count(*) FILTER (completeness >= 90)/count(completeness) AS p9 FROM g GROUP BY hit)
        SELECT hit, n, m AS n_with_value, round(mean, 6) AS mean, round(p5, 6) AS pct_ge_50, round(p7, 6) AS pct_ge_70,
               round(p9, 6) AS pct_ge_90, round({_exclusive(1)}, 6) AS q1, round({_exclusive(2)}, 6) AS median,
               round({_exclusive(3)}, 6) AS q3 FROM s""",
    ("annotated",),
)
def ag38(spark, sf):
    out = stats.group_summary(marked(spark, sf), "hit", "completeness")
    return rounded(out, "mean", "pct_ge_50", "pct_ge_70", "pct_ge_90", "q1", "median", "q3")


PAIRS_SQL = """pairs AS (SELECT DISTINCT rep AS cluster_id, genome FROM members JOIN clusters ON member = target
    WHERE target NOT IN (SELECT target FROM bad_targets)),
    sizes AS (SELECT cluster_id, count(*) AS n_genomes FROM pairs GROUP BY 1)"""
PAIRS = ("members", "clusters", "bad_targets", "facts")


def pairs(spark, sf):
    return richness.cluster_membership(
        rel(spark, sf, "clusters"), rel(spark, sf, "members"), rel(spark, sf, "bad_targets")
    )


@query("jn10_cluster_genome_pairs", f"WITH {PAIRS_SQL} SELECT * FROM pairs", PAIRS)
def jn10(spark, sf):
    return pairs(spark, sf)


BUCKET_SQL = """CASE WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' WHEN n <= 100 THEN '21-100' ELSE '>100' END"""
SMALL_SQL = """links AS (SELECT DISTINCT target AS cluster_id, genome FROM members),
    sz AS (SELECT cluster_id, count(*) AS n FROM links GROUP BY 1)"""


def _target_pairs(spark, sf):
    return rel(spark, sf, "members").select(F.col("target").alias("cluster_id"), "genome").distinct()


@query(
    "ag25_occupancy_spectrum",
    f"""WITH {SMALL_SQL}, b AS (SELECT {BUCKET_SQL} AS bucket, count(*) AS n_clusters, CAST(sum(n) AS BIGINT) AS n_memberships FROM sz GROUP BY 1)
        SELECT bucket, n_clusters, round(100.0*n_clusters/sum(n_clusters) OVER (), 6) AS pct_of_clusters, n_memberships,
               round(100.0*n_memberships/sum(n_memberships) OVER (), 6) AS pct_of_occupancy FROM b""",
    PAIRS,
)
def ag25(spark, sf):
    sizes = richness.cluster_sizes(_target_pairs(spark, sf))
    return rounded(richness.occupancy_spectrum(sizes), "pct_of_clusters", "pct_of_occupancy")


@query(
    "ag26_study_profile",
    f"""WITH {SMALL_SQL}, s AS (SELECT l.*, {BUCKET_SQL} AS bucket, study, habitat, lat, lon FROM links l JOIN sz USING (cluster_id) JOIN facts USING (genome)),
        h AS (SELECT DISTINCT genome, study, habitat, lat, lon FROM s),
        m AS (SELECT study, habitat AS dominant_habitat FROM (SELECT study, habitat, ROW_NUMBER() OVER (PARTITION BY study ORDER BY count(*) DESC, habitat) AS rk FROM h GROUP BY study, habitat) WHERE rk = 1),
        p AS (SELECT study, avg(abs(lat)) AS mean_abs_lat, coalesce(max(lon) - min(lon), 0) AS lon_span FROM h GROUP BY 1)
        SELECT study, count(DISTINCT genome) AS n_genomes, count(DISTINCT cluster_id) AS n_clusters,
          count(DISTINCT CASE WHEN bucket='1' THEN cluster_id END) AS n_1, count(DISTINCT CASE WHEN bucket='2-5' THEN cluster_id END) AS "n_2-5",
          count(DISTINCT CASE WHEN bucket='6-20' THEN cluster_id END) AS "n_6-20", count(DISTINCT CASE WHEN bucket='21-100' THEN cluster_id END) AS "n_21-100",
          count(DISTINCT CASE WHEN bucket='>100' THEN cluster_id END) AS "n_>100", round(any_value(mean_abs_lat), 6) AS mean_abs_lat,
          any_value(lon_span) AS lon_span, any_value(dominant_habitat) AS dominant_habitat, any_value(lon_span) >= 180 AS is_global
        FROM s JOIN m USING (study) JOIN p USING (study) GROUP BY study HAVING count(DISTINCT genome) >= 5""",
    PAIRS,
)
def ag26(spark, sf):
    return rounded(richness.study_profile(_target_pairs(spark, sf), rel(spark, sf, "facts"), 5), "mean_abs_lat")


@query(
    "ag27_cluster_landscape",
    """WITH one AS (SELECT target, arg_max(genome, (ord, genome)) AS genome FROM members GROUP BY target),
       p AS (SELECT DISTINCT rep AS cluster_id, genome FROM one JOIN clusters ON member = target),
       k AS (SELECT * FROM p JOIN facts USING (genome)),
       m AS (SELECT cluster_id, genus AS top_genus FROM (SELECT cluster_id, genus, ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, genus) AS rk FROM k GROUP BY cluster_id, genus) WHERE rk = 1)
       SELECT cluster_id, count(DISTINCT genome) AS n_genomes,
              count(DISTINCT CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN round(lat, 3) || ',' || round(lon, 3) END) AS n_locations,
              count(DISTINCT class_name) AS n_classes, any_value(top_genus) AS top_genus FROM k JOIN m USING (cluster_id) GROUP BY cluster_id""",
    PAIRS,
)
def ag27(spark, sf):
    single = richness.last_genome_per_target(rel(spark, sf, "members"))
    return richness.cluster_landscape(
        richness.cluster_membership(rel(spark, sf, "clusters"), single), rel(spark, sf, "facts")
    )


@query(
    "ag28_rank_abundance",
    f"WITH {PAIRS_SQL} SELECT cluster_id, n_genomes, ROW_NUMBER() OVER (ORDER BY n_genomes DESC, md5(cluster_id)) AS rank FROM sizes",
    PAIRS,
)
def ag28(spark, sf):
    return richness.rank_abundance(richness.cluster_sizes(pairs(spark, sf)))


CHAO_COLS = ["estimate", "ci_low", "ci_high", "pct_observed"]


@query(
    "ag29_chao2_by_threshold",
    f"""WITH l AS (SELECT DISTINCT evalue_cut, query || '/' || target AS cluster_id, genome FROM (SELECT l_suppkey AS query, l_partkey AS target, o_custkey AS genome, l_discount FROM lineitem JOIN orders ON o_orderkey = l_orderkey) , (VALUES (0.02), (0.05), (0.1)) v(evalue_cut) WHERE l_discount <= evalue_cut),
        c AS (SELECT evalue_cut, cluster_id, count(*) AS n FROM l GROUP BY ALL),
        u AS (SELECT evalue_cut, count(DISTINCT genome)::DOUBLE AS units FROM l GROUP BY 1),
        q AS (SELECT evalue_cut, count(*)::DOUBLE AS s, count(*) FILTER (n=1)::DOUBLE AS q1, count(*) FILTER (n=2)::DOUBLE AS q2, any_value(units) AS units, (any_value(units)-1)/any_value(units) AS a FROM c JOIN u USING (evalue_cut) GROUP BY 1),
        e AS (SELECT *, CASE WHEN q2 > 0 THEN s + a*q1*q1/(2*q2) ELSE s + a*q1*(q1-1)/2 END AS est FROM q),
        v AS (SELECT *, CASE WHEN q2 > 0 THEN q2*(a/2*pow(q1/q2,2) + a*a*pow(q1/q2,3) + a*a/4*pow(q1/q2,4))
                ELSE a*q1*(q1-1)/2 + a*q1*pow(2*q1-1,2)/4 - a*pow(q1,4)/(4*est) END AS var FROM e),
        k AS (SELECT *, exp(1.96*sqrt(ln(1+var/pow(est-s,2)))) AS k FROM v)
        SELECT CAST(evalue_cut AS DOUBLE) AS evalue_cut, CAST(units AS BIGINT) AS n_units, CAST(s AS BIGINT) AS observed, CAST(q1 AS BIGINT) AS q1, CAST(q2 AS BIGINT) AS q2,
               round(est, 4) AS estimate, round(s + (est-s)/k, 4) AS ci_low, round(s + (est-s)*k, 4) AS ci_high, round(100*s/est, 4) AS pct_observed FROM k""",
)
def ag29(spark, sf):
    line = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    cuts = F.filter(F.array(F.lit(0.02), F.lit(0.05), F.lit(0.1)), lambda c: F.col("l_discount") <= c)
    links = line.select(
        F.explode(cuts).alias("evalue_cut"),
        F.concat_ws("/", F.col("l_suppkey"), F.col("l_partkey")).alias("cluster_id"),
        F.col("o_custkey").alias("genome"),
    ).distinct()
    units = links.groupBy("evalue_cut").agg(F.count_distinct("genome").alias("_units"))
    incidence = links.groupBy("evalue_cut", "cluster_id").agg(F.count(F.lit(1)).alias("n")).join(units, "evalue_cut")
    return rounded(richness.chao2(incidence, F.col("_units"), ["evalue_cut"]), *CHAO_COLS, digits=4)


@query(
    "ag66_richness_by_study",
    f"""WITH {PAIRS_SQL}, k AS (SELECT * FROM pairs JOIN facts USING (genome)), h AS (SELECT DISTINCT genome, study, habitat FROM k),
        m AS (SELECT study, habitat AS dominant_habitat FROM (SELECT study, habitat, ROW_NUMBER() OVER (PARTITION BY study ORDER BY count(*) DESC, habitat) AS rk FROM h GROUP BY study, habitat) WHERE rk = 1)
        SELECT study, count(DISTINCT genome) AS n_genomes, count(DISTINCT cluster_id) AS n_clusters, any_value(dominant_habitat) AS dominant_habitat
        FROM k JOIN m USING (study) GROUP BY study HAVING count(DISTINCT genome) >= 2""",
    PAIRS,
)
def ag66(spark, sf):
    return richness.richness_by_study(pairs(spark, sf), rel(spark, sf, "facts"))


def _orders_sql(unit: str, weight: str) -> str:
    """Twenty seeded orders of the rows of ``units``: each unit with the total weight up to and with it."""
    return f"""o AS (SELECT perm, {unit}, key, CAST(sum({weight}) OVER (PARTITION BY perm ORDER BY key) AS BIGINT) AS upto
        FROM (SELECT perm, {unit}, {weight}, substr(md5({unit} || '|' || perm || '|7'), 1, 15) AS key FROM units, range(20) r(perm)))"""


GRID_SQL = "xs AS (SELECT DISTINCT CAST(round(1 + i * (t - 1) / 49) AS BIGINT) AS x FROM (SELECT sum({weight}) AS t FROM units), range(50) g(i))"
BAND_SQL = """c AS (SELECT f.perm, x, count(*) FILTER (f.upto <= x) AS seen FROM f, xs GROUP BY ALL),
    band AS (SELECT x, round(avg(seen), 6) AS mean, round(quantile_cont(seen, 0.025), 6) AS low, round(quantile_cont(seen, 0.975), 6) AS high FROM c GROUP BY x)"""
CURVE_SQL = f"""{SMALL_SQL}, units AS (SELECT DISTINCT genome, 1 AS w FROM links), {_orders_sql('genome', 'w')}, {GRID_SQL.format(weight='w')},
    f AS (SELECT perm, cluster_id, min(upto) AS upto FROM links JOIN o USING (genome) GROUP BY ALL), {BAND_SQL}"""


@query("opg10_accumulation_genome_order", f"WITH {CURVE_SQL} SELECT * FROM band", ("members",))
def opg10(spark, sf):
    return rounded(richness.accumulation_curve(_target_pairs(spark, sf), n_perm=20, seed=7), "mean", "low", "high")


@query(
    "opg10_expected_accumulation",
    f"""WITH {SMALL_SQL}, t AS (SELECT count(DISTINCT genome) AS g FROM links), s AS (SELECT n, count(*) AS m FROM sz GROUP BY n)
        SELECT x, round(sum(m * (1 - CASE WHEN g - n < x THEN 0 ELSE exp(lgamma(g-n+1) - lgamma(g-n-x+1) - lgamma(g+1) + lgamma(g-x+1)) END)), 4) AS expected
        FROM s, t, (VALUES (1), (10), (50), (200), (400)) v(x) GROUP BY x""",
    ("members",),
)
def opg10_expected(spark, sf):
    return rounded(richness.expected_accumulation(_target_pairs(spark, sf), [1, 10, 50, 200, 400]), "expected", digits=4)


@query(
    "opg11_accumulation_study_blocks",
    f"""WITH {SMALL_SQL}, m AS (SELECT genome, study FROM (SELECT DISTINCT genome FROM links) JOIN facts USING (genome)),
        units AS (SELECT study, count(*) AS w FROM m GROUP BY 1), {_orders_sql('study', 'w')}, {GRID_SQL.format(weight='w')},
        f AS (SELECT perm, cluster_id, min(upto) AS upto FROM links JOIN m USING (genome) JOIN o USING (study) GROUP BY ALL), {BAND_SQL} SELECT * FROM band""",
    ("members", "facts"),
)
def opg11(spark, sf):
    blocks = rel(spark, sf, "facts").select("genome", F.col("study").alias("block"))
    return rounded(richness.block_accumulation_curve(_target_pairs(spark, sf), blocks, n_perm=20, seed=7), "mean", "low", "high")


@query(
    "opg12_habitat_richness_null",
    f"""WITH {SMALL_SQL}, units AS (SELECT DISTINCT genome, 1 AS w FROM links), {_orders_sql('genome', 'w')},
        h AS (SELECT habitat, count(DISTINCT cluster_id) AS observed, count(DISTINCT genome) AS n_genomes FROM links JOIN facts USING (genome)
              GROUP BY habitat HAVING count(DISTINCT genome) >= 20),
        f AS (SELECT perm, cluster_id, min(upto) AS upto FROM links JOIN o USING (genome) GROUP BY ALL),
        c AS (SELECT habitat, observed, n_genomes, perm, count(*) FILTER (upto <= n_genomes) AS seen FROM h, f GROUP BY ALL)
        SELECT habitat, observed, n_genomes, round(avg(seen), 6) AS expected, round(quantile_cont(seen, 0.025), 6) AS low,
               round(quantile_cont(seen, 0.975), 6) AS high, round(observed / avg(seen), 6) AS ratio,
               round((count(*) FILTER (seen <= observed) + 1) / (count(*) + 1), 6) AS p_low FROM c GROUP BY habitat, observed, n_genomes""",
    ("members", "facts"),
)
def opg12(spark, sf):
    out = richness.habitat_richness_null(_target_pairs(spark, sf), rel(spark, sf, "facts"), n_perm=20, seed=7)
    return rounded(out, "expected", "low", "high", "ratio", "p_low")


@query(
    "opg12_rare_cluster_share",
    f"""WITH {SMALL_SQL}, a AS (SELECT avg((n <= 20)::INT) AS r FROM sz), h AS (SELECT DISTINCT habitat, cluster_id FROM links JOIN facts USING (genome))
        SELECT habitat, count(*) AS n_clusters, round(avg((n <= 20)::INT), 6) AS rare_share, round(log2(avg((n <= 20)::INT)/any_value(r)), 6) AS log2_enrichment
        FROM h JOIN sz USING (cluster_id), a GROUP BY habitat""",
    ("members", "facts"),
)
def opg12_rare(spark, sf):
    out = richness.rare_cluster_share(_target_pairs(spark, sf), rel(spark, sf, "facts"), 20)
    return rounded(out, "rare_share", "log2_enrichment")


@query(
    "opg13_terminal_discovery_rate",
    f"""WITH {CURVE_SQL}, e AS (SELECT max(x) AS top FROM band), s AS (SELECT max(x) AS x FROM band, e WHERE x <= top * 0.95)
        SELECT round((b.mean - a.mean) / (b.x - a.x), 6) AS terminal_rate FROM e JOIN band b ON b.x = top CROSS JOIN s JOIN band a ON a.x = s.x""",
    ("members",),
)
def opg13(spark, sf):
    curve = richness.accumulation_curve(_target_pairs(spark, sf), n_perm=20, seed=7)
    return rounded(richness.terminal_rate(curve), "terminal_rate")


@query(
    "opg14_stratified_sample",
    """WITH k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY phylum ORDER BY substr(md5(genome || '|0|11'), 1, 15), genome) AS _i,
          count(*) OVER (PARTITION BY phylum) AS _n, count(*) OVER () AS _all FROM facts)
       SELECT * EXCLUDE (_i, _n, _all) FROM k WHERE _i <= greatest(1, round(100.0 * _n / _all))""",
    ("facts",),
)
def opg14(spark, sf):
    return richness.stratified_sample(rel(spark, sf, "facts"), "phylum", "genome", 100, seed=11)
