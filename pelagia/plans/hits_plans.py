"""Registered queries over alignment hits."""

from __future__ import annotations

from pelagia.operators import hits as ops
from pelagia.plans.common import FAMILY_ORDER, F, rel, rounded, table
from pelagia.plans.registry import query

BEST_SQL = """best AS (
    SELECT * EXCLUDE (rn) FROM (
        SELECT family, target AS target_id, query AS best_query, evalue, bits, pident, qcov, tcov,
               ROW_NUMBER() OVER (PARTITION BY family, target
                                  ORDER BY evalue, bits DESC, query, pident, qcov, tcov) AS rn
        FROM hits) WHERE rn = 1)"""


@query(
    "ag1_best_hit_per_target",
    """SELECT target AS target_id, first(query ORDER BY evalue, bits DESC, query, pident) AS best_query,
              min(evalue) AS evalue, first(bits ORDER BY evalue, bits DESC, query, pident) AS bits,
              first(pident ORDER BY evalue, bits DESC, query, pident) AS pident,
              first(qcov ORDER BY evalue, bits DESC, query, pident) AS qcov,
              first(tcov ORDER BY evalue, bits DESC, query, pident) AS tcov,
              count(DISTINCT query) AS n_queries_matching
       FROM hits GROUP BY target""",
    ("hits",),
)
def ag1(spark, sf):
    return ops.best_hit_per_target(rel(spark, sf, "hits"))


@query(
    "ag2_best_hit_by_bits",
    """SELECT query, best_target, evalue, bits, pident, qcov, tcov FROM (
         SELECT query, target AS best_target, evalue, bits, pident, qcov, tcov,
                ROW_NUMBER() OVER (PARTITION BY query ORDER BY bits DESC, evalue, target, pident, qcov, tcov) AS rn
         FROM hits WHERE query <> target AND target NOT IN (SELECT target FROM bad_targets)) WHERE rn = 1""",
    ("hits", "bad_targets"),
)
def ag2(spark, sf):
    return ops.best_hit_by_bits(rel(spark, sf, "hits"), rel(spark, sf, "bad_targets"))


@query(
    "ag3_best_hit_per_candidate",
    """WITH manifest AS (SELECT CAST(p_partkey AS VARCHAR) AS candidate, p_brand AS set_name FROM part),
       h AS (SELECT target AS candidate, bits, query FROM hits),
       best AS (SELECT candidate, bits, query, count(*) OVER (PARTITION BY candidate) AS n,
                       ROW_NUMBER() OVER (PARTITION BY candidate ORDER BY bits DESC, query) AS rn FROM h)
       SELECT m.candidate, set_name, bits, query, coalesce(n, 0) AS n_hits,
              CASE WHEN query IS NULL THEN 'no_hit' ELSE 'hit' END AS status
       FROM manifest m LEFT JOIN (SELECT * FROM best WHERE rn = 1) b ON m.candidate = b.candidate""",
    ("hits",),
)
def ag3(spark, sf):
    manifest = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("candidate"), F.col("p_brand").alias("set_name")
    )
    found = rel(spark, sf, "hits").withColumnRenamed("target", "candidate")
    return ops.best_per_candidate(manifest, found, "bits", ["query"])


@query(
    "ag4_best_per_gene_tiers",
    """WITH h AS (SELECT l_orderkey AS gene, CAST(l_suppkey AS VARCHAR) AS query, l_quantity * 2 AS pident,
                         l_extendedprice AS bits, l_linenumber AS qstart, l_linenumber + 90 + l_suppkey % 10 AS qend,
                         110 AS qlen, 1 + l_partkey % 5 AS tstart, 80 + l_partkey % 21 AS tend, 101 AS tlen
                  FROM lineitem),
       b AS (SELECT *, count(*) OVER (PARTITION BY gene) AS n_queries_hit,
                    ROW_NUMBER() OVER (PARTITION BY gene ORDER BY bits DESC, query, pident, qstart, qend, tstart, tend) AS rn
             FROM h),
       c AS (SELECT gene, query AS best_query, pident, bits, (qend - qstart + 1) / qlen AS qcov,
                    (tend - tstart + 1) / tlen AS tcov, n_queries_hit FROM b WHERE rn = 1)
       SELECT gene, best_query, pident, bits, round(qcov, 6) AS qcov, round(tcov, 6) AS tcov, n_queries_hit,
              CASE WHEN qcov >= 0.8 AND tcov >= 0.8 THEN CASE WHEN pident >= 50 THEN 'A' WHEN pident >= 30 THEN 'B' ELSE 'C' END
                   WHEN tcov >= 0.8 THEN 'D' ELSE 'E' END AS tier
       FROM c""",
)
def ag4(spark, sf):
    line = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS gene", "CAST(l_suppkey AS STRING) AS query", "l_quantity * 2 AS pident",
        "l_extendedprice AS bits", "l_linenumber AS qstart", "l_linenumber + 90 + l_suppkey % 10 AS qend",
        "110 AS qlen", "1 + l_partkey % 5 AS tstart", "80 + l_partkey % 21 AS tend", "101 AS tlen",
    )
    return rounded(ops.best_per_gene_from_coordinates(line), "qcov", "tcov")


@query(
    "ag5_family_search_summary",
    f"""WITH {BEST_SQL}, t AS (SELECT family, count(*) AS n_unique_targets,
              count(*) FILTER (evalue <= 1e-5) AS n_targets_evalue_1e_05,
              count(*) FILTER (evalue <= 1e-10) AS n_targets_evalue_1e_10,
              count(*) FILTER (evalue <= 1e-20) AS n_targets_evalue_1e_20,
              count(*) FILTER (qcov >= 0.5) AS n_targets_qcov_half,
              count(*) FILTER (qcov >= 0.5 AND tcov >= 0.5) AS n_targets_both_cov_half
              FROM best GROUP BY family)
        SELECT t.*, n_alignments FROM t JOIN (SELECT family, count(*) AS n_alignments FROM hits GROUP BY family) USING (family)""",
    ("hits",),
)
def ag5(spark, sf):
    return ops.family_summary(rel(spark, sf, "hits"))


@query(
    "ag6_identity_quantiles",
    """SELECT family, quantile_cont(pident, 0.0) AS identity_min, round(quantile_cont(pident, 0.1), 6) AS identity_p10,
              round(quantile_cont(pident, 0.25), 6) AS identity_p25, round(quantile_cont(pident, 0.5), 6) AS identity_median,
              round(quantile_cont(pident, 0.75), 6) AS identity_p75, round(quantile_cont(pident, 0.9), 6) AS identity_p90,
              quantile_cont(pident, 1.0) AS identity_max FROM hits GROUP BY family""",
    ("hits",),
)
def ag6(spark, sf):
    names = [f"identity_{q}" for q in ops.IDENTITY_QUANTILES]
    return rounded(ops.identity_quantiles(rel(spark, sf, "hits")), *names)


@query(
    "ag7_cap_warning",
    """WITH q AS (SELECT family, query, count(*) AS n FROM hits GROUP BY ALL)
       SELECT family, count(*) FILTER (n >= 95) > 0 AS query_hit_cap_warning,
              count(*) FILTER (n >= 95) AS n_queries_at_cap,
              coalesce(string_agg(CASE WHEN n >= 95 THEN query END, '|' ORDER BY query), '') AS queries_at_cap
       FROM q GROUP BY family""",
    ("hits",),
)
def ag7(spark, sf):
    return ops.cap_warning(rel(spark, sf, "hits"), ["family"], max_seqs=100)


@query(
    "ag8_combined_family_summaries",
    f"""WITH {BEST_SQL}, t AS (SELECT family, count(*) AS n_unique_targets, count(*) FILTER (qcov >= 0.5) AS q FROM best GROUP BY family)
        SELECT t.family, CAST(n_alignments AS VARCHAR) AS n_alignments, CAST(n_unique_targets AS VARCHAR) AS n_unique_targets,
               CAST(q AS VARCHAR) AS n_targets_qcov_half, '' AS not_reported
        FROM t JOIN (SELECT family, count(*) AS n_alignments FROM hits GROUP BY family) a ON a.family = t.family""",
    ("hits",),
)
def ag8(spark, sf):
    long = ops.summary_to_long(ops.family_summary(rel(spark, sf, "hits")))
    return ops.combine_summaries(
        long, ["n_alignments", "n_unique_targets", "n_targets_qcov_half", "not_reported"]
    )


@query(
    "ag8_combined_family_targets",
    f"""WITH {BEST_SQL} SELECT family, target_id, best_query, evalue, bits, pident, qcov, tcov FROM best""",
    ("hits",),
)
def ag8_targets(spark, sf):
    everything = rel(spark, sf, "hits")
    halves = [FAMILY_ORDER[:3], FAMILY_ORDER[3:]]
    frames = [ops.best_hit_per_target(everything.where(F.col("family").isin(h)), ["family"]) for h in halves]
    return ops.combine_targets(frames).drop("n_queries_matching")


@query(
    "flt2_hit_thresholds",
    """WITH raw AS (SELECT query, target, CASE WHEN ord % 17 = 0 THEN '' ELSE CAST(evalue AS VARCHAR) END AS evalue,
              CASE WHEN ord % 19 = 0 THEN 'bad' ELSE CAST(qcov AS VARCHAR) END AS qcov, tcov, pident, bits, ord FROM hits)
       SELECT query, target, ord, pident, bits FROM raw
       WHERE coalesce(TRY_CAST(evalue AS DOUBLE), 1.0) <= 0.06 AND coalesce(TRY_CAST(qcov AS DOUBLE), 0.0) >= 0.95
             AND tcov >= 0.7 AND pident >= 40 AND bits >= 20000""",
    ("hits",),
)
def flt2(spark, sf):
    raw = rel(spark, sf, "hits").selectExpr(
        "query", "target", "CASE WHEN ord % 17 = 0 THEN '' ELSE CAST(evalue AS STRING) END AS evalue",
        "CASE WHEN ord % 19 = 0 THEN 'bad' ELSE CAST(qcov AS STRING) END AS qcov", "tcov", "pident", "bits", "ord",
    )
    kept = ops.threshold_filter(raw, max_evalue=0.06, min_qcov=0.95, min_tcov=0.7, min_pident=40, min_bits=20000)
    return kept.select("query", "target", "ord", "pident", "bits")


@query(
    "flt3_divergent_hits",
    """SELECT query, target, alnlen, pident, qcov, tcov, ord FROM hits
       WHERE alnlen BETWEEN 150 AND 700 AND qcov >= 0.6 AND tcov >= 0.6 AND pident < 35""",
    ("hits",),
)
def flt3(spark, sf):
    kept = ops.divergent_filter(rel(spark, sf, "hits"))
    return kept.select("query", "target", "alnlen", "pident", "qcov", "tcov", "ord")


@query(
    "wn7_round_robin_batch",
    """SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS i
       FROM orders) WHERE i % 7 = 3""",
)
def wn7(spark, sf):
    records = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return ops.batch_of(records, "o_orderkey", 7, 3, F.expr("o_orderkey DIV 65536"))


@query(
    "st5_batches_equal_whole",
    """SELECT target AS target_id, count(DISTINCT query) AS n_queries_matching, min(evalue) AS evalue
       FROM hits GROUP BY target""",
    ("hits",),
)
def st5(spark, sf):
    batches = rel(spark, sf, "hits").withColumn("batch", F.col("query").cast("long") % 4)
    whole = ops.concat_batches(batches, 4)
    return ops.best_hit_per_target(whole).select("target_id", "n_queries_matching", "evalue")
