"""Registered queries over the genome × family matrix and the exclusion lists."""

from __future__ import annotations

from pelagia.operators import matrix as ops
from pelagia.plans.common import ARCH_SQL, FAMILY_ORDER, MATRIX_SQL, F, family_matrix, rel, rounded, table
from pelagia.plans.registry import query

NEEDS = ("annotated", "bad_queries")
ZONE_SQL = """CASE WHEN depth_m IS NULL THEN '(unknown depth)' WHEN greatest(depth_m, 0) < 50 THEN '0-50m'
    WHEN depth_m < 200 THEN '50-200m' WHEN depth_m < 1000 THEN '200-1000m' WHEN depth_m < 4000 THEN '1000-4000m'
    ELSE '>4000m' END"""


def _top_sql(source: str, group: str, column: str, n: int, name: str) -> str:
    return f"""{name}_t AS (SELECT {group}, string_agg({column} || ' (' || n || ')', '; ' ORDER BY rk) AS {name} FROM (
        SELECT {group}, {column}, count(*) AS n, ROW_NUMBER() OVER (PARTITION BY {group} ORDER BY count(*) DESC, {column}) AS rk
        FROM {source} WHERE {column} <> '' GROUP BY {group}, {column}) WHERE rk <= {n} GROUP BY {group})"""


@query(
    "jn4_exclusion_anti_join",
    """SELECT a.target_id, a.family, a.best_query, a.genome, a.ord FROM annotated a WHERE NOT EXISTS (
         SELECT 1 FROM bad_queries b WHERE b.family = a.family AND b.best_query = a.best_query)""",
    NEEDS,
)
def jn4(spark, sf):
    kept = ops.drop_bad_queries(rel(spark, sf, "annotated"), rel(spark, sf, "bad_queries"))
    return kept.select("target_id", "family", "best_query", "genome", "ord")


@query(
    "jn5_bad_target_exclusion",
    """WITH bad AS (SELECT target AS target_id FROM bad_targets UNION SELECT a.target_id FROM annotated a
         JOIN bad_queries b ON b.family = a.family AND b.best_query = a.best_query WHERE a.family = 'phaC')
       SELECT family, count(*) AS n_rows, count(DISTINCT target_id) AS n_targets FROM annotated
       WHERE target_id NOT IN (SELECT target_id FROM bad) GROUP BY family""",
    (*NEEDS, "bad_targets"),
)
def jn5(spark, sf):
    rows = rel(spark, sf, "annotated")
    bad = ops.bad_target_set(
        rows.where("family = 'phaC'"), rel(spark, sf, "bad_queries"), rel(spark, sf, "bad_targets")
    )
    kept = ops.drop_bad_targets(rows, bad)
    return kept.groupBy("family").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("target_id").alias("n_targets")
    )


@query("ag16_genome_family_matrix", f"WITH {MATRIX_SQL}, {ARCH_SQL} SELECT * FROM arch", NEEDS)
def ag16(spark, sf):
    return family_matrix(spark, sf)


@query(
    "ag17_architecture_summary",
    f"""WITH {MATRIX_SQL}, {ARCH_SQL}, {_top_sql('arch', 'architecture', 'genus', 5, 'top_genus')},
        {_top_sql('arch', 'architecture', 'species', 5, 'top_species')}, {_top_sql('arch', 'architecture', 'study', 5, 'top_study')}
        SELECT a.architecture, n_genomes, n_distinct_studies, round(100.0 * n_genomes / total, 6) AS pct_of_genomes,
               families_present, top_genus, top_species, top_study
        FROM (SELECT architecture, count(*) AS n_genomes, count(DISTINCT study) AS n_distinct_studies,
                     sum(count(*)) OVER () AS total,
                     concat_ws(',', {', '.join(f"CASE WHEN any_value(n_{f}) > 0 THEN '{f}' END" for f in FAMILY_ORDER)}) AS families_present
              FROM arch GROUP BY architecture) a
        LEFT JOIN top_genus_t USING (architecture) LEFT JOIN top_species_t USING (architecture)
        LEFT JOIN top_study_t USING (architecture)""",
    NEEDS,
)
def ag17(spark, sf):
    return rounded(ops.architecture_summary(family_matrix(spark, sf), FAMILY_ORDER), "pct_of_genomes")


@query(
    "ag9_clade_depth_long",
    f"""SELECT best_query AS clade, {ZONE_SQL} AS zone, count(DISTINCT genome) AS n_genomes,
               count(DISTINCT target_id) AS n_targets FROM annotated GROUP BY ALL""",
    ("annotated",),
)
def ag9_long(spark, sf):
    return ops.clade_depth_counts(rel(spark, sf, "annotated"), "best_query")


@query(
    "ag9_clade_depth_wide",
    f"""WITH c AS (SELECT genus AS clade, {ZONE_SQL} AS zone, count(DISTINCT genome) AS n FROM annotated GROUP BY ALL)
        SELECT clade, CAST(sum(n) AS BIGINT) AS total_genomes,
               coalesce(max(n) FILTER (zone = '0-50m'), 0) AS "0-50m",
               coalesce(max(n) FILTER (zone = '50-200m'), 0) AS "50-200m",
               coalesce(max(n) FILTER (zone = '200-1000m'), 0) AS "200-1000m",
               coalesce(max(n) FILTER (zone = '1000-4000m'), 0) AS "1000-4000m",
               coalesce(max(n) FILTER (zone = '>4000m'), 0) AS ">4000m",
               coalesce(max(n) FILTER (zone = '(unknown depth)'), 0) AS "(unknown depth)"
        FROM c GROUP BY clade""",
    ("annotated",),
)
def ag9_wide(spark, sf):
    return ops.clade_depth_wide(ops.clade_depth_counts(rel(spark, sf, "annotated"), "genus"))


@query(
    "tk3_zones_in_depth_order",
    f"""WITH c AS (SELECT habitat AS clade, {ZONE_SQL} AS zone, count(DISTINCT genome) AS n_genomes FROM annotated GROUP BY ALL)
        SELECT clade, zone, n_genomes, CAST(CASE zone WHEN '0-50m' THEN 1 WHEN '50-200m' THEN 2 WHEN '200-1000m' THEN 3
               WHEN '1000-4000m' THEN 4 WHEN '>4000m' THEN 5 ELSE 6 END AS INT) AS zone_order FROM c""",
    ("annotated",),
)
def tk3(spark, sf):
    counts = ops.clade_depth_counts(rel(spark, sf, "annotated"), "habitat").drop("n_targets")
    return ops.zone_ordinal(counts).orderBy("clade", "zone_order")


CORRECTED_SQL = f"""{MATRIX_SQL}, carriers AS (SELECT CAST(c_custkey AS VARCHAR) AS genome FROM customer WHERE c_custkey % 3 = 0),
    sets AS (SELECT coalesce(m.genome, c.genome) AS genome, concat_ws('+',
        {', '.join(f"CASE WHEN n_{f} > 0 THEN '{f}' END" if f != 'phaC' else "CASE WHEN c.genome IS NOT NULL THEN 'phaC' END" for f in FAMILY_ORDER)}) AS architecture
        FROM matrix m FULL JOIN carriers c ON m.genome = c.genome),
    counted AS (SELECT architecture, count(*) AS n_genomes, contains(architecture, 'phaC') AS has_forced,
        CAST(len(string_split(architecture, '+')) AS INT) AS n_families FROM sets WHERE architecture <> '' GROUP BY architecture)"""


def _corrected(spark, sf):
    carriers = table(spark, sf, "customer").where("c_custkey % 3 = 0")
    carriers = carriers.select(F.col("c_custkey").cast("string").alias("genome"))
    return ops.corrected_architectures(family_matrix(spark, sf), FAMILY_ORDER, "phaC", carriers)


@query("ag18_corrected_architectures", f"WITH {CORRECTED_SQL} SELECT * FROM counted", NEEDS)
def ag18(spark, sf):
    return _corrected(spark, sf)


@query(
    "ag18_top_architectures",
    f"""WITH {CORRECTED_SQL} SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY has_forced ORDER BY n_genomes DESC, architecture) AS INT) AS rank
        FROM counted WHERE has_forced OR n_families > 4 QUALIFY rank <= CASE WHEN has_forced THEN 30 ELSE 10 END""",
    NEEDS,
)
def ag18_top(spark, sf):
    return ops.top_architectures(_corrected(spark, sf), min_families=4)


@query(
    "ag18_family_totals",
    f"""WITH {CORRECTED_SQL} SELECT family, CAST(sum(n_genomes) AS BIGINT) AS n_genomes
        FROM (SELECT unnest(string_split(architecture, '+')) AS family, n_genomes FROM counted WHERE has_forced) GROUP BY family""",
    NEEDS,
)
def ag18_totals(spark, sf):
    return ops.family_totals(_corrected(spark, sf))


@query(
    "flt1_qualifying_genomes",
    f"WITH {MATRIX_SQL} SELECT genome, n_families_present FROM matrix WHERE n_phaC = 0 AND n_families_present > 4",
    NEEDS,
)
def flt1(spark, sf):
    from pelagia.operators.audit import qualifying_genomes

    return qualifying_genomes(family_matrix(spark, sf), "n_phaC", 4).select("genome", "n_families_present")
