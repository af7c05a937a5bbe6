"""Registered queries: filters, evidence groups, copy number, taxonomy roll-ups, sets and top lists."""

from __future__ import annotations

from pelagia.operators import audit as ops
from pelagia.operators import ecology, hits as hit_ops
from pelagia.plans.common import ARCH_SQL, FAMILY_ORDER, MATRIX_SQL, F, family_matrix, rel, rounded, table
from pelagia.plans.ecology_plans import CG_SQL, POS_SQL, positives
from pelagia.plans.enrich_plans import COPIES_SQL, copies
from pelagia.plans.matrix_plans import _top_sql
from pelagia.plans.registry import query
from pelagia.plans.stats_plans import MH_SQL, marked

M = ("annotated", "bad_queries")


@query(
    "flt4_usable_habitats",
    f"""WITH {POS_SQL} SELECT habitat, count(*) AS n_all, count(p.genome) AS n_positive FROM facts f LEFT JOIN pos p ON p.genome = f.genome
        WHERE habitat NOT IN ('NA', '', 'BUILDING') GROUP BY habitat HAVING count(*) >= 200 AND count(p.genome) >= 20""",
    ("annotated",),
)
def flt4(spark, sf):
    return ops.usable_habitats(marked(spark, sf), ["NA", "", "BUILDING"], F.col("hit"), 200, 20)


TEMP_SQL = """tp AS (SELECT f.*, CASE WHEN CAST(genome AS BIGINT) % 9 = 0 THEN NULL ELSE CAST(CAST(genome AS BIGINT) % 28 AS DOUBLE) - 1.5 END AS temp FROM facts f)"""


def climate_rows(spark, sf):
    key = F.col("genome").cast("long")
    return rel(spark, sf, "facts").withColumn("temp", F.when(key % 9 != 0, (key % 28).cast("double") - 1.5))


@query("flt5_usable_climate_rows", f"WITH {TEMP_SQL} SELECT genome, temp, depth_m FROM tp WHERE temp IS NOT NULL AND depth_m >= 0", ("facts",))
def flt5(spark, sf):
    return ops.with_climate(climate_rows(spark, sf)).select("genome", "temp", "depth_m")


@query(
    "flt5_climate_metrics",
    f"""WITH {TEMP_SQL} SELECT count(*) AS n_rows, count(*) FILTER (temp IS NOT NULL AND depth_m >= 0) AS n_usable,
        count(*) FILTER (temp IS NOT NULL AND depth_m < 0) AS n_negative_depth FROM tp""",
    ("facts",),
)
def flt5_metrics(spark, sf):
    return ops.climate_metrics(climate_rows(spark, sf))


PRED_SQL = """pr AS (SELECT o_orderkey, o_totalprice / 1000 AS length, f.*, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey % 28 AS DOUBLE) - 1.5 END AS temp,
    CASE o_orderpriority WHEN '1-URGENT' THEN '80<=' WHEN '2-HIGH' THEN '[60-65)' WHEN '3-MEDIUM' THEN '<40' WHEN '5-LOW' THEN '[75-80)' ELSE 'other' END AS label
    FROM orders JOIN facts f ON f.genome = CAST(o_custkey AS VARCHAR)),
    pm AS (SELECT *, CASE label WHEN '80<=' THEN 82.5 WHEN '[60-65)' THEN 62.5 WHEN '<40' THEN 37.5 WHEN '[75-80)' THEN 77.5 END::DOUBLE AS predicted FROM pr)"""


def predictions(spark, sf):
    from pelagia.functions.evidence import THERMAL_MIDPOINTS, mapped

    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "CAST(o_custkey AS STRING) AS genome", "o_totalprice / 1000 AS length",
        "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey % 28 AS DOUBLE) - CAST(1.5 AS DOUBLE) END AS temp",
        "CASE o_orderpriority WHEN '1-URGENT' THEN '80<=' WHEN '2-HIGH' THEN '[60-65)' WHEN '3-MEDIUM' THEN '<40' WHEN '5-LOW' THEN '[75-80)' ELSE 'other' END AS label",
    )
    rows = rows.join(rel(spark, sf, "facts"), "genome")
    return rows.withColumn("predicted", mapped(F.col("label"), THERMAL_MIDPOINTS))


@query(
    "flt6_attrition_funnel",
    f"""WITH {PRED_SQL} SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'bad target' WHEN length < 150 THEN 'short' WHEN temp IS NULL THEN 'no temperature'
        WHEN predicted IS NULL THEN 'no label' ELSE 'kept' END AS step, count(*) AS n_rows FROM pm GROUP BY 1""",
    ("facts",),
)
def flt6(spark, sf):
    steps = [
        ("bad target", F.col("o_orderkey") % 50 == 0),
        ("short", F.col("length") < 150),
        ("no temperature", F.col("temp").isNull()),
        ("no label", F.col("predicted").isNull()),
    ]
    return ops.attrition(predictions(spark, sf), steps)


@query(
    "flt7_context_gate",
    """WITH e AS (SELECT conv_id AS record, unnest([turn, turn + 1]) AS local_id, lower(text) AS t FROM conversations)
       SELECT conv_id AS record, turn AS local_id FROM conversations c WHERE EXISTS (SELECT 1 FROM e WHERE e.record = c.conv_id AND e.local_id = c.turn
         AND (contains(t, ' the ') OR contains(t, 'tion de')))""",
)
def flt7(spark, sf):
    rows = table(spark, sf, "conversations")
    proteins = rows.select(F.col("conv_id").alias("record"), F.col("turn").alias("local_id"))
    entries = rows.select(
        F.col("conv_id").alias("record"), F.col("text").alias("value"), F.lit(None).cast("string").alias("comment"),
        F.array(F.col("turn"), F.col("turn") + 1).alias("proteins"),
    )
    return ops.context_gate(proteins, entries, [" the ", "tion de"])


@query(
    "flt8_excluded_genes",
    """SELECT p_partkey FROM part WHERE p_brand NOT IN ('Brand#3', 'ECONOMY') AND p_type NOT IN ('Brand#3', 'ECONOMY')""",
)
def flt8(spark, sf):
    entries = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("gene_name"), F.array("p_type").alias("gene_synonyms"))
    return ops.excluded_gene_filter(entries, ["Brand#3", "ECONOMY"]).select("p_partkey")


@query(
    "flt9_extreme_quadrant_taxa",
    f"""WITH {PRED_SQL} SELECT genus, species, family_name, phylum, count(*) AS n_proteins, string_agg(DISTINCT study, ',' ORDER BY study) AS studies,
        round(median(temp), 6) AS median_temp, round(median(depth_m), 6) AS median_depth FROM pm WHERE temp <= 5 AND predicted >= 82.5 GROUP BY ALL""",
    ("facts",),
)
def flt9(spark, sf):
    return rounded(ops.extreme_quadrant_taxa(predictions(spark, sf)), "median_temp", "median_depth")


@query(
    "flt10_low_oxygen_share",
    """SELECT habitat, count(*) AS n, count(*) FILTER (o < 63) AS n_low, round(100.0 * count(*) FILTER (o < 63) / count(*), 6) AS pct_low
       FROM (SELECT habitat, CAST((CAST(genome AS BIGINT) * 7) % 300 AS DOUBLE) AS o FROM facts WHERE CAST(genome AS BIGINT) % 8 <> 0) GROUP BY 1""",
    ("facts",),
)
def flt10(spark, sf):
    key = F.col("genome").cast("long")
    rows = rel(spark, sf, "facts").withColumn("oxygen", F.when(key % 8 != 0, ((key * 7) % 300).cast("double")))
    return rounded(ops.low_oxygen_share(rows, "habitat"), "pct_low")


@query(
    "flt11_keep_if_unknown",
    f"""WITH {COPIES_SQL}, s AS (SELECT cp.*, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size / 50.0 END::DOUBLE AS score FROM cp JOIN part ON CAST(p_partkey AS VARCHAR) = target_id),
        k AS (SELECT * FROM s WHERE coalesce(score, 0.5) >= 0.5) SELECT genome, target_id, cluster_id FROM k QUALIFY count(*) OVER (PARTITION BY genome) >= 25""",
    ("members", "clusters"),
)
def flt11(spark, sf):
    scores = table(spark, sf, "part").selectExpr(
        "CAST(p_partkey AS STRING) AS target_id", "CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 50 END AS score"
    )
    rows = copies(spark, sf).join(scores, "target_id")
    return ops.keep_if_unknown(rows, "score", 0.5, "genome", 25).select("genome", "target_id", "cluster_id")


TARGETS_SQL = "tg AS (SELECT DISTINCT genome, target_id FROM annotated WHERE family = 'phaC')"


def _targets(spark, sf):
    return rel(spark, sf, "annotated").where("family = 'phaC'").select("genome", "target_id").distinct()


@query(
    "ag39_evidence_groups",
    f"""WITH {MATRIX_SQL}, {TARGETS_SQL}, fl AS (SELECT genome, bool_or(p_size = 7) AS t, bool_or(p_size BETWEEN 10 AND 14) AS m FROM tg JOIN part ON CAST(p_partkey AS VARCHAR) = target_id GROUP BY genome),
        o AS (SELECT genome, n_families_present - (n_phaC > 0)::INT AS n_other FROM matrix)
        SELECT genome, CASE WHEN t THEN 'triad complete' WHEN m THEN 'model support, no triad' WHEN n_other >= 5 THEN 'no support, five or more other families'
               WHEN n_other >= 1 THEN 'no support, one to four other families' ELSE 'family alone' END AS evidence_group FROM o JOIN fl USING (genome)""",
    M,
)
def ag39(spark, sf):
    part = table(spark, sf, "part").withColumn("target_id", F.col("p_partkey").cast("string"))
    other = F.col("n_families_present") - (F.col("n_phaC") > 0).cast("int")
    genomes = family_matrix(spark, sf).withColumn("n_other", other)
    return ops.evidence_groups(genomes, _targets(spark, sf), part.where("p_size = 7"), part.where("p_size BETWEEN 10 AND 14"))


CORR_SQL = f"""{MATRIX_SQL}, bl AS (SELECT genome, count(*) AS b FROM members WHERE target IN (SELECT target FROM bad_targets) GROUP BY genome),
    cc AS (SELECT m.*, greatest(n_phaC - coalesce(b, 0), 0) AS n_copies FROM matrix m LEFT JOIN bl ON bl.genome = m.genome WHERE n_phaC > 0),
    co AS (SELECT * FROM cc WHERE n_copies > 0 AND CAST(genome AS BIGINT) % 31 <> 0)"""
CORR = (*M, "members", "bad_targets")


def corrected(spark, sf):
    bad = rel(spark, sf, "members").join(rel(spark, sf, "bad_targets"), "target", "left_semi")
    artifacts = table(spark, sf, "customer").where("c_custkey % 31 = 0").selectExpr("CAST(c_custkey AS STRING) AS genome")
    return ops.corrected_copies(family_matrix(spark, sf), "n_phaC", bad, artifacts)


@query("ag40_corrected_copies", f"WITH {CORR_SQL} SELECT genome, n_phaC, n_copies FROM co", CORR)
def ag40(spark, sf):
    return corrected(spark, sf).select("genome", "n_phaC", "n_copies")


@query(
    "ag41_multicopy_by_phylum",
    f"""WITH {CORR_SQL} SELECT phylum, count(*) AS n_genomes, count(*) FILTER (n_copies >= 2) AS n_multicopy,
        round(100.0 * count(*) FILTER (n_copies >= 2) / count(*), 6) AS pct_multicopy, round(avg(n_copies), 6) AS mean_copies FROM co GROUP BY phylum""",
    CORR,
)
def ag41(spark, sf):
    return rounded(ops.multicopy_by(corrected(spark, sf), "phylum"), "pct_multicopy", "mean_copies")


@query(
    "ag41_multicopy_tests_by_habitat",
    f"""WITH {CORR_SQL}, ins AS (SELECT habitat, phylum, count(*) FILTER (n_copies >= 2) AS a, count(*) FILTER (n_copies < 2) AS b FROM co GROUP BY ALL),
        t AS (SELECT habitat, phylum, a, b, sum(a) OVER (PARTITION BY phylum) - a AS c, sum(b) OVER (PARTITION BY phylum) - b AS d FROM ins),
        {MH_SQL.format(by='habitat', src='t')} SELECT habitat, n_strata_used, round(sr/ss, 6) AS odds_ratio, round(pow(abs(sa-se), 2)/sv, 6) AS cmh_chi2 FROM mh""",
    CORR,
)
def ag41_tests(spark, sf):
    out = ops.multicopy_tests(corrected(spark, sf), "habitat", "phylum", with_p=False).drop("ci_low", "ci_high")
    return rounded(out, "odds_ratio", "cmh_chi2")


@query(
    "ag41_contamination_by_copies",
    f"""WITH {CORR_SQL} SELECT CASE WHEN n_copies <= 1 THEN '1' WHEN n_copies <= 2 THEN '2' WHEN n_copies <= 4 THEN '3-4' WHEN n_copies <= 9 THEN '5-9' ELSE '10+' END AS copies,
        count(*) AS n, round(avg(contamination), 6) AS mean_contamination, round(stddev_samp(contamination) / sqrt(count(*)), 6) AS sem
        FROM co JOIN (SELECT genome, contamination FROM facts) USING (genome) GROUP BY 1""",
    CORR,
)
def ag41_contamination(spark, sf):
    rows = corrected(spark, sf).join(rel(spark, sf, "facts").select("genome", "contamination"), "genome")
    return rounded(ops.contamination_by_copies(rows), "mean_contamination", "sem")


@query(
    "ag42_multicopy_audit",
    f"""WITH {TARGETS_SQL}, r AS (SELECT genome, target_id, CASE WHEN p_partkey % 6 <> 0 THEN p_size > 15 END AS triad,
            CASE WHEN p_partkey % 5 <> 0 THEN p_size * 20 END AS length, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS cl,
            CASE WHEN p_partkey % 4 <> 0 THEN 'scaffold_' || (p_size % 3) END AS sc FROM tg JOIN part ON CAST(p_partkey AS VARCHAR) = target_id),
        b AS (SELECT genome, count(*) AS n_targets, count(*) FILTER (triad)::DOUBLE / nullif(count(triad), 0) AS pt, count(*) FILTER (length >= 500)::DOUBLE / nullif(count(length), 0) AS pf,
            count(DISTINCT cl) AS n_distinct_clusters, count(DISTINCT cl)::DOUBLE / nullif(count(cl), 0) AS pd, list_sort(list(length) FILTER (length IS NOT NULL)) AS l FROM r GROUP BY genome),
        c AS (SELECT genome, count(*) AS n_contigs, max(n) AS max_on_contig FROM (SELECT genome, sc, count(*) AS n FROM r WHERE sc IS NOT NULL GROUP BY ALL) GROUP BY genome),
        q AS (SELECT genome, contamination FROM facts WHERE CAST(genome AS BIGINT) % 3 <> 0)
        SELECT b.genome, n_targets, round(pt, 6) AS pct_triad, round(pf, 6) AS pct_full_length, n_distinct_clusters, round(pd, 6) AS pct_distinct_clusters,
            CAST(l[len(l) // 2 + 1] AS DOUBLE) AS median_length, coalesce(n_contigs, 0) AS n_contigs, coalesce(max_on_contig, 0) AS max_on_contig, contamination,
            CASE WHEN pt IS NULL OR pd IS NULL THEN 'insufficient_data' WHEN pt >= 0.6 AND pd >= 0.6 AND coalesce(contamination <= 10, true) THEN 'likely_legit'
                 WHEN pt < 0.3 OR pd < 0.3 OR coalesce(contamination > 10, false) THEN 'likely_artifact' ELSE 'uncertain' END AS call
        FROM b LEFT JOIN c ON c.genome = b.genome LEFT JOIN q ON q.genome = b.genome""",
    M,
)
def ag42(spark, sf):
    part = table(spark, sf, "part").withColumn("target_id", F.col("p_partkey").cast("string"))
    targets = _targets(spark, sf)
    triads = part.where("p_partkey % 6 <> 0").select("target_id", (F.col("p_size") > 15).alias("flag"))
    lengths = part.where("p_partkey % 5 <> 0").select("target_id", (F.col("p_size") * 20).alias("length"))
    clusters = part.where("p_partkey % 7 <> 0").select(F.col("target_id").alias("member"), F.col("p_brand").alias("rep"))
    scaffold = F.concat(F.lit("scaffold_"), (F.col("p_size") % 3).cast("string")).alias("scaffold")
    places = targets.join(part.where("p_partkey % 4 <> 0").select("target_id", scaffold), "target_id")
    quality = rel(spark, sf, "facts").where(F.col("genome").cast("long") % 3 != 0).select("genome", "contamination")
    out = ops.multicopy_audit(targets, triads, lengths, clusters, places, quality)
    return rounded(out, "pct_triad", "pct_full_length", "pct_distinct_clusters")


@query(
    "ag43_high_copy_by_study",
    f"""WITH {CORR_SQL} SELECT study, count(*) AS n_genomes, count(*) FILTER (n_copies >= 7) AS n_high, round(100.0 * count(*) FILTER (n_copies >= 7) / count(*), 6) AS pct_high,
        max(n_copies) AS max_copies FROM co GROUP BY study HAVING count(*) >= 20""",
    CORR,
)
def ag43(spark, sf):
    return rounded(ops.high_copy_by_study(corrected(spark, sf), "n_copies", 7, 20), "pct_high")


@query(
    "ag43_tail_concentration",
    f"""WITH {CORR_SQL}, s AS (SELECT species, count(*) AS n, ROW_NUMBER() OVER (ORDER BY count(*) DESC, species) AS r FROM co WHERE n_copies >= 7 GROUP BY species)
        SELECT count(*) AS n_categories, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n) FILTER (r <= 5) AS BIGINT) AS n_top, round(100.0 * sum(n) FILTER (r <= 5) / sum(n), 6) AS pct_top FROM s""",
    CORR,
)
def ag43_tail(spark, sf):
    return rounded(ops.tail_concentration(corrected(spark, sf).where("n_copies >= 7"), "species"), "pct_top")


@query(
    "ag44_penetrance_and_consistency",
    f"""WITH {MATRIX_SQL}, {ARCH_SQL}, q AS (SELECT * FROM arch WHERE n_families_present > 6),
        c AS (SELECT genus, architecture, count(*) AS n, ROW_NUMBER() OVER (PARTITION BY genus ORDER BY count(*) DESC, architecture) AS r, count(*) OVER (PARTITION BY genus) AS k FROM q GROUP BY genus, architecture)
        SELECT t.genus, n_total, n_qualifying, round(100.0 * n_qualifying / n_total, 6) AS penetrance, round(100.0 * n / n_qualifying, 6) AS consistency, architecture AS top_architecture, k AS n_architectures
        FROM (SELECT genus, count(*) AS n_total, count(*) FILTER (n_families_present > 6) AS n_qualifying FROM arch GROUP BY genus) t JOIN c ON c.genus = t.genus AND r = 1 WHERE n_qualifying >= 20""",
    M,
)
def ag44(spark, sf):
    out = ops.penetrance_and_consistency(family_matrix(spark, sf), F.col("n_families_present") > 6, 20)
    return rounded(out, "penetrance", "consistency")


@query(
    "ag45_folded_hierarchy",
    """WITH c AS (SELECT genus, species, count(*) AS n FROM facts GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY genus) AS p, count(*) FILTER (n < 12) OVER (PARTITION BY genus) AS k FROM c)
       SELECT CASE WHEN p >= 58 THEN genus ELSE 'Other' END AS genus, CASE WHEN p < 58 THEN '' WHEN n < 12 THEN k || ' smaller' ELSE species END AS species, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY 1, 2""",
    ("facts",),
)
def ag45(spark, sf):
    return ops.folded_hierarchy(rel(spark, sf, "facts"), "genus", "species", 58, 12)


# Small clusters, so that many of them stay inside one phylum.
SINGLE_SQL = """sp AS (SELECT c_custkey // 2 AS cluster_id, count(DISTINCT phylum) AS np, max(phylum) AS phylum, arg_min(domain_name, c_custkey) AS domain_name,
      arg_min(class_name, c_custkey) AS class_name, arg_min(order_name, c_custkey) AS order_name FROM customer JOIN facts ON genome = CAST(c_custkey AS VARCHAR)
      GROUP BY 1 HAVING count(DISTINCT phylum) = 1),
    cn AS (SELECT phylum, class_name, order_name, count(*) AS n FROM sp GROUP BY ALL),
    pc AS (SELECT *, count(*) FILTER (class_rank > 3) OVER (PARTITION BY phylum) AS small_c FROM (SELECT phylum, class_name, sum(n) AS cn, ROW_NUMBER() OVER (PARTITION BY phylum ORDER BY sum(n) DESC, class_name) AS class_rank FROM cn GROUP BY phylum, class_name)),
    rk AS (SELECT *, count(*) FILTER (order_rank > 2) OVER (PARTITION BY phylum, class_name) AS small_o FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY phylum, class_name ORDER BY n DESC, order_name) AS order_rank FROM cn)),
    lf AS (SELECT phylum, class_name, order_name, n, CASE WHEN class_rank > 3 THEN small_c || ' smaller classes' ELSE class_name END AS leaf_class,
      CASE WHEN class_rank > 3 THEN '(mixed)' WHEN order_rank > 2 THEN small_o || ' smaller orders' ELSE order_name END AS leaf_order FROM rk JOIN pc USING (phylum, class_name))"""


def leaves(spark, sf):
    rows = rel(spark, sf, "facts").join(
        table(spark, sf, "customer").selectExpr("CAST(c_custkey AS STRING) AS genome", "c_custkey AS ord", "c_custkey DIV 2 AS cluster_id"), "genome"
    )
    return ops.taxonomy_leaves(ops.single_phylum_clusters(rows))


@query(
    "ag46_taxonomy_rollup",
    f"WITH {SINGLE_SQL} SELECT phylum, leaf_class, leaf_order, CAST(sum(n) AS BIGINT) AS n_clusters FROM lf GROUP BY ALL",
    ("facts",),
)
def ag46(spark, sf):
    return ops.leaf_counts(leaves(spark, sf))


@query(
    "ag67_rate_per_leaf",
    f"""WITH {POS_SQL}, {SINGLE_SQL} SELECT lf.phylum, leaf_class, leaf_order, count(*) AS n_genomes, round(100.0 * count(p.genome) / count(*), 6) AS pct_positive
        FROM facts f JOIN lf ON lf.phylum = f.phylum AND lf.class_name = f.class_name AND lf.order_name = f.order_name LEFT JOIN pos p ON p.genome = f.genome GROUP BY ALL""",
    ("annotated",),
)
def ag67(spark, sf):
    return rounded(ops.rate_per_leaf(marked(spark, sf), leaves(spark, sf), F.col("hit")), "pct_positive")


@query(
    "ag47_host_breadth",
    f"""WITH {CG_SQL} SELECT genus, phylum, count(*) AS n_genomes, CAST(count(DISTINCT genus) OVER () AS INT) AS n_genera, CAST(count(DISTINCT phylum) OVER () AS INT) AS n_phyla
        FROM cg WHERE cluster_id = 'Brand#7/ECONOMY' GROUP BY genus, phylum""",
    ("annotated", "clusters"),
)
def ag47(spark, sf):
    rows = ecology.with_clusters(rel(spark, sf, "annotated"), rel(spark, sf, "clusters"))
    return ops.host_breadth(ecology.cluster_genomes(rows, ["genus", "phylum"]), "Brand#7/ECONOMY")


@query(
    "ag48_class_by_phylum",
    f"""WITH {MATRIX_SQL}, {TARGETS_SQL}, c AS (SELECT CAST(p_partkey AS VARCHAR) AS target_id, CASE p_size % 5 WHEN 0 THEN 'I' WHEN 1 THEN 'II' WHEN 2 THEN 'III' WHEN 3 THEN 'III' ELSE 'x' END AS mc, p_size > 25 AS confident FROM part),
        j AS (SELECT phylum, confident, CASE WHEN mc IN ('I', 'II') THEN mc WHEN mc = 'III' AND n_phaE > 3 THEN 'III' WHEN mc = 'III' AND n_phaR_regulator > 3 THEN 'IV' WHEN mc = 'III' THEN 'III/IV, no partner found' ELSE 'unassigned' END AS k
              FROM tg JOIN c USING (target_id) JOIN matrix USING (genome))
        SELECT phylum, count(*) AS n_copies, count(*) FILTER (confident) AS n_confident, count(*) FILTER (k = 'I') AS "I", count(*) FILTER (k = 'II') AS "II", count(*) FILTER (k = 'III') AS "III",
               count(*) FILTER (k = 'IV') AS "IV", count(*) FILTER (k = 'III/IV, no partner found') AS "III/IV, no partner found", count(*) FILTER (k = 'unassigned') AS unassigned
        FROM j GROUP BY phylum ORDER BY n_copies DESC, phylum LIMIT 10""",
    M,
)
def ag48(spark, sf):
    kind = "CASE p_size % 5 WHEN 0 THEN 'I' WHEN 1 THEN 'II' WHEN 2 THEN 'III' WHEN 3 THEN 'III' ELSE 'x' END AS model_class"
    classes = table(spark, sf, "part").selectExpr("CAST(p_partkey AS STRING) AS target_id", kind, "p_size > 25 AS confident")
    genomes = family_matrix(spark, sf).withColumn("has_e", F.col("n_phaE") > 3).withColumn("has_r", F.col("n_phaR_regulator") > 3)
    return ops.class_by_phylum(_targets(spark, sf), classes, genomes)


MARK_CTE = """mk AS (SELECT DISTINCT user_id AS genome, event_type AS marker FROM events WHERE value > 200),
    pg AS (SELECT c_custkey AS genome, c_mktsegment AS subclade, c_acctbal AS completeness, coalesce(list_sort(list(marker) FILTER (marker IN ('click', 'error', 'view'))), []) AS l
           FROM customer LEFT JOIN mk ON mk.genome = c_custkey GROUP BY ALL),
    mt AS (SELECT genome, subclade, completeness, CAST(len(l) AS INT) AS n_markers, array_to_string(l, ',') AS markers, CASE WHEN list_contains(l, 'click') THEN 'yes' ELSE 'no' END AS has_click,
           CASE WHEN list_contains(l, 'error') THEN 'yes' ELSE 'no' END AS has_error, CASE WHEN list_contains(l, 'view') THEN 'yes' ELSE 'no' END AS has_view,
           CASE WHEN list_contains(l, 'click') AND list_contains(l, 'view') THEN 'yes' ELSE 'no' END AS complete_core FROM pg)"""


def marker_table(spark, sf):
    found = table(spark, sf, "events").where("value > 200").select(F.col("user_id").alias("genome"), F.col("event_type").alias("marker"))
    genomes = table(spark, sf, "customer").selectExpr("c_custkey AS genome", "c_mktsegment AS subclade", "c_acctbal AS completeness")
    return ops.marker_completeness(found, genomes, ["click", "error", "view"], {"core": ["click", "view"]})


@query("ag49_marker_completeness", f"WITH {MARK_CTE} SELECT * FROM mt")
def ag49(spark, sf):
    return marker_table(spark, sf)


@query(
    "ag49_completeness_rollup",
    f"""WITH {MARK_CTE} SELECT subclade, count(*) AS n_genomes, round(avg(completeness), 6) AS mean_quality, min(completeness) AS min_quality,
        count(*) FILTER (has_click = 'yes') AS n_has_click, count(*) FILTER (complete_core = 'yes') AS n_complete_core FROM mt GROUP BY 1""",
)
def ag49_rollup(spark, sf):
    return rounded(ops.completeness_rollup(marker_table(spark, sf), "subclade", ["has_click", "complete_core"]), "mean_quality")


ROUTE_SQL = """rt AS (SELECT *, n_phaA > 0 AND n_phaB > 0 AS ab, n_phaG > 6 AS g, n_phaJ > 6 AS j FROM matrix)"""


def routed(spark, sf):
    """Routes over a matrix whose G and J counts are reduced, so that all combinations occur."""
    matrix = family_matrix(spark, sf)
    matrix = matrix.withColumn("n_phaG", F.greatest(F.col("n_phaG") - 6, F.lit(0))).withColumn("n_phaJ", F.greatest(F.col("n_phaJ") - 6, F.lit(0)))
    return ops.with_routes(matrix)


@query(
    "ag50_route_combinations",
    f"""WITH {MATRIX_SQL}, {ROUTE_SQL} SELECT coalesce(nullif(CASE WHEN ab THEN 'AB' ELSE '' END || CASE WHEN g THEN 'G' ELSE '' END || CASE WHEN j THEN 'J' ELSE '' END, ''), '(none)') AS combo,
        CASE WHEN g AND j THEN 'Both (G+J)' WHEN g THEN 'FAS-linked only (G)' WHEN j THEN 'Beta-oxidation only (J)' ELSE 'Neither' END AS strategy, count(*) AS n_genomes,
        round(100.0 * count(*) FILTER (ab) / count(*), 6) AS pct_ab, round(100.0 * count(*) FILTER (g) / count(*), 6) AS pct_g, round(100.0 * count(*) FILTER (j) / count(*), 6) AS pct_j FROM rt GROUP BY 1, 2""",
    M,
)
def ag50(spark, sf):
    return rounded(ops.route_counts(routed(spark, sf), ["combo", "strategy"]), "pct_ab", "pct_g", "pct_j")


@query(
    "ag50_routes_by_phylum",
    f"""WITH {MATRIX_SQL}, {ROUTE_SQL} SELECT phylum, count(*) AS n_genomes, round(100.0 * count(*) FILTER (ab) / count(*), 6) AS pct_ab,
        round(100.0 * count(*) FILTER (g) / count(*), 6) AS pct_g, round(100.0 * count(*) FILTER (j) / count(*), 6) AS pct_j FROM rt GROUP BY 1""",
    M,
)
def ag50_phylum(spark, sf):
    return rounded(ops.route_counts(routed(spark, sf), ["phylum"]), "pct_ab", "pct_g", "pct_j")


@query(
    "ag51_cluster_route_association",
    f"""WITH {MATRIX_SQL}, {ROUTE_SQL}, pl AS (SELECT CAST(c_custkey AS VARCHAR) AS genome, 'cl' || (c_custkey % 20) AS cluster_id FROM customer),
        r AS (SELECT cluster_id, phylum, g, j FROM rt JOIN pl USING (genome)),
        ins AS (SELECT cluster_id, phylum, count(*) FILTER (g) AS a, count(*) FILTER (NOT g) AS b FROM r GROUP BY ALL),
        t AS (SELECT cluster_id, phylum, a, b, sum(a) OVER (PARTITION BY phylum) - a AS c, sum(b) OVER (PARTITION BY phylum) - b AS d FROM ins),
        {MH_SQL.format(by='cluster_id', src='t')}, tp AS (SELECT cluster_id, phylum, a+b AS n FROM ins QUALIFY ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY a+b DESC, phylum) = 1),
        bs AS (SELECT cluster_id, count(*) AS n_genomes, round(100.0 * count(*) FILTER (g) / count(*), 6) AS pct_g, round(100.0 * count(*) FILTER (j) / count(*), 6) AS pct_j, count(*) FILTER (NOT g AND NOT j) AS n_neither FROM r GROUP BY 1)
        SELECT bs.*, tp.phylum AS top_phylum, round(100.0 * tp.n / n_genomes, 6) AS top_phylum_pct, round(sr/ss, 6) AS odds_ratio, round(pow(abs(sa-se), 2)/sv, 6) AS cmh_chi2, n_strata_used
        FROM bs JOIN tp USING (cluster_id) JOIN mh USING (cluster_id) WHERE n_genomes >= 30""",
    M,
)
def ag51(spark, sf):
    placed = table(spark, sf, "customer").selectExpr("CAST(c_custkey AS STRING) AS genome", "concat('cl', c_custkey % 20) AS cluster_id")
    out = ops.cluster_route_association(routed(spark, sf), placed, with_p=False).drop("ci_low", "ci_high")
    return rounded(out, "pct_g", "pct_j", "top_phylum_pct", "odds_ratio", "cmh_chi2")


@query(
    "ag52_binned_medians",
    """SELECT floor(pident / 5) * 5 + 2.5 AS centre, round(median(bits), 6) AS median, count(*) AS n FROM hits GROUP BY floor(pident / 5) HAVING count(*) >= 25""",
    ("hits",),
)
def ag52(spark, sf):
    return rounded(ops.binned_medians(rel(spark, sf, "hits"), "pident", "bits"), "median")


@query(
    "ag52_running_windows",
    """SELECT CAST(k * 2 + 3 AS DOUBLE) AS centre, round(quantile_cont(bits, 0.25), 6) AS p25, round(median(bits), 6) AS median, round(quantile_cont(bits, 0.75), 6) AS p75, count(*) AS n
       FROM hits, generate_series(0, 47) g(k) WHERE pident >= k * 2 AND pident < k * 2 + 6 GROUP BY k HAVING count(*) >= 25""",
    ("hits",),
)
def ag52_running(spark, sf):
    return rounded(ops.running_windows(rel(spark, sf, "hits"), "pident", "bits"), "p25", "median", "p75")


@query(
    "ag53_threshold_shares",
    """SELECT CASE WHEN pident < 30 THEN '0-30' WHEN pident < 40 THEN '30-40' WHEN pident < 50 THEN '40-50' WHEN pident < 70 THEN '50-70' ELSE '70-100.0' END AS bin,
       count(*) AS n, round(avg((bits >= 50000)::INT), 6) AS share_ge_50000, round(avg((bits >= 85000)::INT), 6) AS share_ge_85000 FROM hits GROUP BY 1""",
    ("hits",),
)
def ag53(spark, sf):
    out = ops.threshold_shares(rel(spark, sf, "hits"), "pident", "bits", [0, 30, 40, 50, 70, 100.0001], [50000, 85000])
    out = out.withColumn("bin", F.when(F.col("bin") == "70-100", "70-100.0").otherwise(F.col("bin")))
    return rounded(out, "share_ge_50000", "share_ge_85000")


DOCK_SQL = """dk AS (SELECT s_name AS receptor, p_type AS ligand, CAST(length(p_type) % 3 * 2 + 4 AS INT) AS carbons, -avg(l_extendedprice) / 10000 AS affinity, CAST(20 + length(p_type) AS INT) AS heavy_atoms
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY s_name, p_type)"""


def docking(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    size = F.length("ligand")
    out = rows.groupBy(F.col("s_name").alias("receptor"), F.col("p_type").alias("ligand")).agg((-F.avg("l_extendedprice") / 10000).alias("affinity"))
    return out.select("receptor", "ligand", (size % 3 * 2 + 4).cast("int").alias("carbons"), "affinity", (size + 20).cast("int").alias("heavy_atoms"))


REFS = ["Supplier#000000001", "Supplier#000000002"]


@query(
    "ag57_docking_preference",
    f"""WITH {DOCK_SQL}, b AS (SELECT ligand, avg(affinity) AS base FROM dk WHERE receptor IN ('Supplier#000000001', 'Supplier#000000002') GROUP BY 1)
        SELECT receptor, dk.ligand, carbons, round(affinity, 6) AS affinity, round(affinity - base, 6) AS vs_reference, round(affinity / heavy_atoms, 6) AS ligand_efficiency FROM dk LEFT JOIN b ON b.ligand = dk.ligand""",
)
def ag57(spark, sf):
    return rounded(ops.docking_preference(docking(spark, sf), REFS), "affinity", "vs_reference", "ligand_efficiency")


@query(
    "ag57_chain_length_shift",
    f"""WITH {DOCK_SQL} SELECT receptor, round(avg(affinity) FILTER (carbons = 8) - avg(affinity) FILTER (carbons = 4), 6) AS shift FROM dk GROUP BY 1 HAVING shift IS NOT NULL""",
)
def ag57_shift(spark, sf):
    return rounded(ops.chain_length_shift(docking(spark, sf)), "shift")


@query(
    "ag57_noise_floor",
    f"""WITH {DOCK_SQL}, g AS (SELECT abs(avg(affinity) FILTER (receptor = 'Supplier#000000001') - avg(affinity) FILTER (receptor = 'Supplier#000000002')) AS gap FROM dk GROUP BY ligand)
        SELECT round(avg(gap), 6) AS mean_gap, round(min(gap), 6) AS min_gap, round(max(gap), 6) AS max_gap FROM g""",
)
def ag57_noise(spark, sf):
    return rounded(ops.noise_floor(docking(spark, sf), *REFS), "mean_gap", "min_gap", "max_gap")


@query(
    "ag58_cross_genome_conservation",
    f"""WITH {COPIES_SQL}, p AS (SELECT cluster_id, genome, count(*) AS n_copies FROM cp GROUP BY ALL) SELECT *, count(*) OVER (PARTITION BY cluster_id) AS n_genomes_sharing FROM p""",
    ("members", "clusters"),
)
def ag58(spark, sf):
    return ops.cross_genome_conservation(copies(spark, sf))


@query(
    "ag59_variant_table",
    f"""WITH o AS (SELECT DISTINCT target_id, genome, genus FROM annotated), {_top_sql('o', 'target_id', 'genus', 5, 'genera')}
        SELECT target_id, n_genomes, genera FROM (SELECT target_id, count(*) AS n_genomes FROM o GROUP BY 1) LEFT JOIN genera_t USING (target_id)""",
    ("annotated",),
)
def ag59(spark, sf):
    # The genus goes to the orders, which are fewer than the hits.
    genera = rel(spark, sf, "facts").select("genome", "genus")
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("genome")).join(genera, "genome")
    rows = table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return ops.variant_table(rows.select(F.col("l_partkey").cast("string").alias("target_id"), "genome", "genus"))


@query(
    "ag60_genome_breakdown",
    f"""WITH {TARGETS_SQL}, f AS (SELECT genome, target_id, CAST(target_id AS BIGINT) % 2 = 0 AS k FROM tg)
        SELECT genome, count(*) AS n_copies, bool_or(k) AS any_flag, bool_and(k) AS all_flag, coalesce(string_agg(target_id, ',' ORDER BY target_id) FILTER (k), '') AS with_flag,
               coalesce(string_agg(target_id, ',' ORDER BY target_id) FILTER (NOT k), '') AS without_flag FROM f GROUP BY genome""",
    M,
)
def ag60(spark, sf):
    rows = _targets(spark, sf).withColumn("even", F.col("target_id").cast("long") % 2 == 0)
    return ops.genome_breakdown(rows, "even")


@query(
    "ag61_mean_counts_by_group",
    f"""WITH {MATRIX_SQL} SELECT CASE WHEN n_phaC >= 6 THEN 'high' ELSE 'low' END AS "group", count(*) AS n_genomes, {', '.join(f'round(avg(n_{f}), 6) AS mean_{f}' for f in FAMILY_ORDER)} FROM matrix GROUP BY 1""",
    M,
)
def ag61(spark, sf):
    out = ops.mean_counts_by_group(family_matrix(spark, sf), FAMILY_ORDER, F.col("n_phaC") >= 6)
    return rounded(out, *[f"mean_{f}" for f in FAMILY_ORDER])


LONG_SQL = f"""{TARGETS_SQL}, lt AS (SELECT genome, target_id, CAST(p_size * 20 AS INT) AS length FROM tg JOIN part ON CAST(p_partkey AS VARCHAR) = target_id
    QUALIFY ROW_NUMBER() OVER (PARTITION BY genome ORDER BY p_size DESC, target_id) = 1)"""


def _longest(spark, sf):
    lengths = table(spark, sf, "part").selectExpr("CAST(p_partkey AS STRING) AS target_id", "p_size * 20 AS length")
    return ops.longest_target_per_genome(_targets(spark, sf), lengths)


@query(
    "ag63_divergent_candidates",
    f"""WITH {LONG_SQL}, b AS (SELECT target AS target_id, query AS best_target, evalue, bits, pident, qcov, tcov FROM hits WHERE query <> target
          QUALIFY ROW_NUMBER() OVER (PARTITION BY target ORDER BY bits DESC, evalue, query, pident, qcov, tcov) = 1)
        SELECT genome, lt.target_id, length, best_target, pident, phylum, depth_m FROM lt JOIN b USING (target_id) LEFT JOIN facts USING (genome)
        WHERE pident < 85 AND length BETWEEN 150 AND 1000 AND qcov >= 0.6 AND tcov >= 0.6""",
    ("annotated", "hits"),
)
def ag63(spark, sf):
    flipped = rel(spark, sf, "hits").selectExpr("target AS query", "query AS target", "evalue", "bits", "pident", "qcov", "tcov")
    out = ops.divergent_candidates(
        _longest(spark, sf), hit_ops.best_hit_by_bits(flipped), rel(spark, sf, "facts"), 85.0, (150, 1000)
    )
    return out.select("genome", "target_id", "length", "best_target", "pident", "phylum", "depth_m")


@query("ag63_deepest_candidates", f"WITH {LONG_SQL} SELECT genome, target_id, length, depth_m FROM lt JOIN facts USING (genome) WHERE depth_m > 6000", ("annotated",))
def ag63_deep(spark, sf):
    return ops.deepest_candidates(_longest(spark, sf), rel(spark, sf, "facts")).select("genome", "target_id", "length", "depth_m")


@query(
    "ag64_group_composition",
    """WITH c AS (SELECT habitat, genus, count(*) AS n FROM facts GROUP BY ALL), t AS (SELECT genus FROM c GROUP BY 1 ORDER BY sum(n) DESC, genus LIMIT 8),
       f AS (SELECT habitat, CASE WHEN genus IN (SELECT genus FROM t) THEN genus ELSE 'Other' END AS genus, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2)
       SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY habitat), 6) AS pct FROM f""",
    ("facts",),
)
def ag64(spark, sf):
    return rounded(ops.group_composition(rel(spark, sf, "facts"), "habitat", "genus"), "pct")


@query(
    "ag65_metric_by_group",
    """SELECT phylum, count(*) AS n, count(*) FILTER (depth_m IS NULL) AS n_missing, round(quantile_cont(depth_m, 0.25), 6) AS p25, round(median(depth_m), 6) AS median, round(quantile_cont(depth_m, 0.75), 6) AS p75 FROM facts GROUP BY 1""",
    ("facts",),
)
def ag65(spark, sf):
    return rounded(ops.metric_by_group(rel(spark, sf, "facts"), "phylum", "depth_m"), "p25", "median", "p75")


@query(
    "ag22_status_by_tier",
    """SELECT l_returnflag AS family, l_linestatus AS tier, count(*) AS n, CAST(sum((l_discount > 0.05)::INT) AS BIGINT) AS n_review FROM lineitem GROUP BY ALL""",
)
def ag22(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_returnflag AS family", "l_linestatus AS tier", "l_discount > CAST(0.05 AS DOUBLE) AS needs_manual_review")
    return ops.status_table(rows)


@query(
    "ag22_table_counts",
    "SELECT 'orders' AS \"table\", count(*) AS n_rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events",
)
def ag22_counts(spark, sf):
    return ops.table_counts({name: table(spark, sf, name) for name in ("orders", "lineitem", "events")})


@query(
    "st1_union_with_provenance",
    """WITH s AS (SELECT doc_id, 'long' AS s FROM documents WHERE n_chars > 2000 UNION SELECT doc_id, 'labelled' FROM labels UNION SELECT doc_id, 'english' FROM documents WHERE lang = 'en'
         UNION SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1 UNION SELECT doc_id, 'first' FROM documents WHERE source = 'src1')
       SELECT doc_id, string_agg(s, ',' ORDER BY s) AS sources, any_value(n_chars) AS length FROM s JOIN documents USING (doc_id) WHERE n_chars >= 150 GROUP BY doc_id""",
)
def st1(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    sources = {
        "long": docs.where("n_chars > 2000"), "labelled": labels, "english": docs.where("lang = 'en'"),
        "toxic": labels.where("toxic = 1"), "first": docs.where("source = 'src1'"),
    }
    return ops.union_with_provenance(sources, "doc_id", docs.selectExpr("doc_id", "n_chars AS length"), 150)


@query("st2_union_of_two_columns", "SELECT o_custkey, o_orderstatus AS value FROM orders UNION SELECT o_custkey, o_orderpriority FROM orders")
def st2(spark, sf):
    return ops.union_distinct(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", "o_orderpriority")


MANIFEST_SQL = "m AS (SELECT CAST(p_partkey AS VARCHAR) AS target_id, p_brand AS set_name FROM part)"


def _manifest(spark, sf):
    return table(spark, sf, "part").selectExpr("CAST(p_partkey AS STRING) AS target_id", "p_brand AS set_name")


@query(
    "st3_replaced_set",
    f"WITH {MANIFEST_SQL} SELECT * FROM m WHERE set_name <> 'Brand#5' UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'Brand#5' FROM supplier",
)
def st3(spark, sf):
    fresh = table(spark, sf, "supplier").selectExpr("CAST(s_suppkey AS STRING) AS target_id")
    once = ops.replace_set(_manifest(spark, sf), fresh, "Brand#5")
    return ops.replace_set(once, fresh, "Brand#5")


@query(
    "st3_appended_missing",
    f"WITH {MANIFEST_SQL} SELECT * FROM m UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'new' FROM orders WHERE CAST(o_orderkey AS VARCHAR) NOT IN (SELECT target_id FROM m)",
)
def st3_append(spark, sf):
    return ops.append_missing(_manifest(spark, sf), table(spark, sf, "orders").selectExpr("CAST(o_orderkey AS STRING) AS target_id"), "new")


@query(
    "st4_set_relations",
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'),
       j AS (SELECT a.k AS x, b.k AS y FROM a FULL JOIN b ON a.k = b.k)
       SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_both, count(*) FILTER (y IS NULL) AS n_only_a, count(*) FILTER (x IS NULL) AS n_only_b,
              count(*) FILTER (y IS NULL) = 0 AS a_in_b, count(*) FILTER (x IS NULL) = 0 AS b_in_a FROM j""",
)
def st4(spark, sf):
    orders = table(spark, sf, "orders")
    return ops.set_relations(orders.where("o_orderstatus = 'F'"), orders.where("o_orderpriority = '1-URGENT'"), "o_custkey")


@query(
    "tk1_top_clusters_with_extras",
    """WITH s AS (SELECT p_brand AS cluster_id, count(*) AS n FROM part GROUP BY 1), t AS (SELECT cluster_id, CAST(ROW_NUMBER() OVER (ORDER BY n DESC, cluster_id) AS INT) AS position FROM s QUALIFY position <= 8),
       e AS (SELECT * FROM (VALUES ('Brand#6', 1), ('Brand#19', 2), ('Brand#24', 3)) v(cluster_id, o))
       SELECT * FROM t UNION ALL SELECT e.cluster_id, CAST(8 + o AS INT) FROM e JOIN s USING (cluster_id) WHERE e.cluster_id NOT IN (SELECT cluster_id FROM t)""",
)
def tk1(spark, sf):
    sizes = table(spark, sf, "part").groupBy(F.col("p_brand").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n"))
    return ops.top_with_extras(sizes, "cluster_id", "n", 8, ["Brand#6", "Brand#19", "Brand#24"])


@query(
    "tk2_ranked_architectures",
    f"""WITH {MATRIX_SQL}, {ARCH_SQL}, a AS (SELECT architecture, count(*) AS n_genomes FROM arch GROUP BY 1)
        SELECT architecture, n_genomes, CAST(ROW_NUMBER() OVER (ORDER BY n_genomes DESC, architecture) AS INT) AS rank FROM a""",
    M,
)
def tk2(spark, sf):
    counts = family_matrix(spark, sf).groupBy("architecture").agg(F.count(F.lit(1)).alias("n_genomes"))
    return ops.ranked_list(counts, "architecture", "n_genomes")
