"""Registered queries: k-mers, similarity, triads, communities and ordination."""

from __future__ import annotations

from pelagia.operators import community, greedy_clusters, sequences
from pelagia.plans.common import F, rel, rounded, table
from pelagia.plans.function_plans import LETTERS, letters
from pelagia.plans.registry import query


def documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), letters().alias("sequence"))


@query(
    "opg5_kmer_composition",
    f"""WITH d AS (SELECT doc_id AS id, {LETTERS} AS s FROM documents), k AS (SELECT id, substr(s, i, 2) AS kmer FROM (SELECT id, s, unnest(range(1, length(s))) AS i FROM d)),
        c AS (SELECT id, kmer, count(*) AS n FROM k WHERE regexp_full_match(kmer, '[ACDEFGHIKLMNPQRSTVWY]+') GROUP BY ALL)
        SELECT id, kmer, round(n / sum(n) OVER (PARTITION BY id), 6) AS share FROM c""",
)
def opg5(spark, sf):
    return rounded(sequences.kmer_composition(documents(spark, sf), "id", 2), "share")


@query("opg5_composition_projection")
def opg5_projection(spark, sf):
    return sequences.project_two(sequences.composition_vectors(documents(spark, sf), "id", 2), "id")


@query(
    "opg7_kmer_clusters",
    """WITH RECURSIVE t AS (SELECT doc_id, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS s FROM documents),
       d AS (SELECT min(doc_id) AS id, s FROM t GROUP BY s),
       km AS (SELECT DISTINCT id, substr(s, i, 8) AS k FROM (SELECT id, s, unnest(range(1, length(s) - 6)) AS i FROM d)),
       n AS (SELECT id, count(*) AS n, length(any_value(s)) AS len FROM km JOIN d USING (id) GROUP BY id),
       r AS (SELECT id, n, len, ROW_NUMBER() OVER (ORDER BY n DESC, md5(CAST(id AS VARCHAR)), id) AS r FROM n),
       sh AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM km a JOIN km b ON a.k = b.k AND a.id <> b.id GROUP BY ALL),
       nb AS (SELECT v.r, list(u.r) AS earlier FROM sh JOIN r v ON v.id = x JOIN r u ON u.id = y
              WHERE u.r < v.r AND c >= ceil(round(v.n * 0.8, 9)) AND least(u.len, v.len) >= 0.9 * greatest(u.len, v.len) GROUP BY v.r),
       g(step, reps) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
              SELECT step + 1, CASE WHEN list_has_any(reps, coalesce(earlier, [])) THEN reps ELSE list_append(reps, step + 1) END
              FROM g LEFT JOIN nb ON nb.r = step + 1 WHERE step < (SELECT count(*) FROM r)),
       z AS (SELECT reps FROM g ORDER BY step DESC LIMIT 1),
       p AS (SELECT r.id, coalesce(list_min(list_intersect(earlier, reps)), r.r) AS rr FROM r LEFT JOIN nb USING (r), z),
       w AS (SELECT p.id, q.id AS rep FROM p JOIN r q ON q.r = p.rr)
       SELECT t.doc_id AS member, coalesce(w.rep, d.id) AS rep FROM t JOIN d USING (s) LEFT JOIN w ON w.id = d.id""",
)
def opg7(spark, sf):
    return greedy_clusters.cluster_by_kmers(documents(spark, sf), "id")


@query(
    "opg8_kmer_search",
    """WITH q AS (SELECT item_id AS id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM benchmark), t AS (SELECT doc_id AS id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM documents),
       qk AS (SELECT DISTINCT id, substr(s, i, 8) AS k FROM (SELECT id, s, unnest(range(1, length(s) - 6)) AS i FROM q)),
       tk AS (SELECT DISTINCT id, substr(s, i, 8) AS k FROM (SELECT id, s, unnest(range(1, length(s) - 6)) AS i FROM t)),
       qn AS (SELECT id, count(*) AS n FROM qk GROUP BY 1), tn AS (SELECT id, count(*) AS n FROM tk GROUP BY 1),
       h AS (SELECT qk.id AS query, tk.id AS target, count(*) AS bits FROM qk JOIN tk ON tk.k = qk.k GROUP BY ALL),
       v AS (SELECT query, target, bits, bits / qn.n AS qcov, bits / tn.n AS tcov FROM h JOIN qn ON qn.id = query JOIN tn ON tn.id = target)
       SELECT query, target, CAST(bits AS INT) AS bits, round(qcov, 6) AS qcov, round(tcov, 6) AS tcov
       FROM v WHERE qcov >= 0.2""",
)
def opg8(spark, sf):
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), letters().alias("sequence"))
    targets = documents(spark, sf).withColumnRenamed("id", "target")
    return rounded(sequences.kmer_search(queries, targets, min_containment=0.2), "qcov", "tcov")


PLAIN = "regexp_replace(text, '[^ -~]', '')"


@query(
    "opg9_pair_identity",
    """WITH t AS (SELECT conv_id, turn, regexp_replace(text, '[^ -~]', '', 'g') AS s FROM conversations)
       SELECT a.conv_id * 1000 + a.turn AS a, b.conv_id * 1000 + b.turn AS b, round(100.0 * (1 - levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s))), 6) AS identity
       FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""",
)
def opg9(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.expr(PLAIN).alias("sequence"))
    following = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("id").alias("b"))
    pairs = rows.select("conv_id", "turn", F.col("id").alias("a")).join(following, ["conv_id", "turn"]).select("a", "b")
    return rounded(sequences.pair_identity(pairs, rows), "identity")


ATOM_SQL = """atm AS (SELECT DISTINCT l_suppkey AS structure, CAST(l_partkey AS INT) AS position, CASE CAST(l_partkey % 4 AS INT) WHEN 0 THEN 'C' WHEN 1 THEN 'H' WHEN 2 THEN 'D' ELSE 'S' END AS residue,
    CASE CAST(l_partkey % 12 AS INT) WHEN 0 THEN 'SG' WHEN 1 THEN 'NE2' WHEN 2 THEN 'OD1' WHEN 3 THEN 'OG' ELSE 'CA' END AS atom, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem)"""


def atoms(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS structure", "CAST(l_partkey AS INT) AS position", "CASE CAST(l_partkey % 4 AS INT) WHEN 0 THEN 'C' WHEN 1 THEN 'H' WHEN 2 THEN 'D' ELSE 'S' END AS residue",
        "CASE CAST(l_partkey % 12 AS INT) WHEN 0 THEN 'SG' WHEN 1 THEN 'NE2' WHEN 2 THEN 'OD1' WHEN 3 THEN 'OG' ELSE 'CA' END AS atom", "l_quantity AS x", "l_extendedprice / 1000 AS y", "l_discount * 100 AS z",
    ).distinct()


TRIAD_SQL = f"""{ATOM_SQL}, pt AS (SELECT *, bool_or(atom <> 'CA') OVER (PARTITION BY structure, position) AS has FROM atm),
    gp AS (SELECT a.structure, a.residue AS ra, a.position AS pa, b.residue AS rb, b.position AS pb, min(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2))) AS d
           FROM pt a JOIN pt b ON b.structure = a.structure AND a.residue || b.residue IN ('CH', 'SH', 'HD', 'CD', 'SD')
           WHERE CASE WHEN a.has AND b.has THEN a.atom <> 'CA' AND b.atom <> 'CA' ELSE a.atom = 'CA' AND b.atom = 'CA' END GROUP BY ALL),
    n1 AS (SELECT structure, ra AS kind, pa AS nuc, pb AS his, d FROM gp WHERE rb = 'H' QUALIFY ROW_NUMBER() OVER (PARTITION BY structure, kind, his ORDER BY d, nuc) = 1),
    d1 AS (SELECT structure, pa AS his, pb AS asp, d FROM gp WHERE ra = 'H' QUALIFY ROW_NUMBER() OVER (PARTITION BY structure, his ORDER BY d, asp) = 1),
    tr AS (SELECT n1.structure, n1.kind, nuc AS nucleophile, n1.his, asp, round(n1.d, 6) AS nuc_his, round(d1.d, 6) AS his_asp, round(na.d, 6) AS nuc_asp, round(n1.d + d1.d, 6) AS score,
           nuc < asp AND asp < n1.his AS in_order, n1.d <= 4.5 AND d1.d <= 4.5 AS tight
           FROM n1 JOIN d1 ON d1.structure = n1.structure AND d1.his = n1.his
           LEFT JOIN gp na ON na.structure = n1.structure AND na.ra = n1.kind AND na.rb = 'D' AND na.pa = nuc AND na.pb = asp
           QUALIFY ROW_NUMBER() OVER (PARTITION BY n1.structure, n1.kind ORDER BY n1.d + d1.d, n1.his) = 1)"""


@query(
    "jn20_triad_details",
    f"""WITH {TRIAD_SQL}, ca AS (SELECT l_suppkey AS structure, CAST(l_partkey AS INT) AS position, max(l_tax) AS confidence FROM lineitem
          WHERE l_partkey % 12 > 3 GROUP BY ALL)
        SELECT tr.* EXCLUDE (kind), CASE WHEN structure % 2 = 0 THEN (nucleophile - 3) % 7 = 0 ELSE (nucleophile - 3) % 10 = 0 END AS nuc_in_motif,
               n.confidence AS nuc_confidence, a.confidence AS asp_confidence, h.confidence AS his_confidence
        FROM tr LEFT JOIN ca n ON n.structure = tr.structure AND n.position = nucleophile LEFT JOIN ca a ON a.structure = tr.structure AND a.position = asp
             LEFT JOIN ca h ON h.structure = tr.structure AND h.position = his WHERE kind = 'C'""".replace("CASE WHEN structure %", "CASE WHEN tr.structure %"),
)
def jn20_details(spark, sf):
    levels = table(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS structure", "CAST(l_partkey AS INT) AS position", "CASE WHEN l_partkey % 12 > 3 THEN 'CA' ELSE 'side' END AS atom", "l_tax AS confidence"
    )
    # Stretches with one motif each, as far as the residues of a structure go; in the second kind another match would overlap it.
    proteins = levels.groupBy("structure").agg(F.max("position").alias("reach"))
    text = F.expr("CASE WHEN structure % 2 = 0 THEN repeat('GACAGAC', CAST(reach DIV 7 AS INT) + 2) ELSE repeat('GACAGTCTGW', CAST(reach DIV 10 AS INT) + 2) END")
    found = rounded(sequences.structural_triads(atoms(spark, sf)), "nuc_his", "his_asp", "nuc_asp", "score")
    return sequences.triad_details(found, levels, proteins, sequence=text)


@query("jn20_structural_triads", f"WITH {TRIAD_SQL} SELECT * EXCLUDE (kind) FROM tr WHERE kind = 'C'")
def jn20(spark, sf):
    return rounded(sequences.structural_triads(atoms(spark, sf)), "nuc_his", "his_asp", "nuc_asp", "score")


@query(
    "jn20_triads_with_fallback",
    f"""WITH {TRIAD_SQL}, al AS (SELECT *, CASE WHEN kind = 'C' AND tight THEN 1 WHEN kind = 'S' AND tight THEN 2 WHEN kind = 'C' THEN 3 END AS turn FROM tr)
        SELECT * EXCLUDE (turn) REPLACE (CASE WHEN kind = 'C' THEN 'C' ELSE 'S/T' END AS kind) FROM al WHERE turn IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY structure ORDER BY turn) = 1""",
)
def jn20_fallback(spark, sf):
    return rounded(sequences.triad_with_fallback(atoms(spark, sf)), "nuc_his", "his_asp", "nuc_asp", "score")


SITE_SQL = """rw AS (SELECT sample_id AS site, rep AS cluster_id, lat, lon, study, habitat, ord FROM annotated JOIN clusters ON member = target_id WHERE lat IS NOT NULL AND lon IS NOT NULL),
    ct AS (SELECT site, cluster_id, count(*) AS n FROM rw GROUP BY ALL),
    rc AS (SELECT site, count(*) AS richness FROM ct GROUP BY 1 HAVING count(*) >= 3),
    k AS (SELECT ct.* FROM ct JOIN rc USING (site))"""
NEEDS = ("annotated", "clusters")


def sites(spark, sf, max_sites=None):
    named = rel(spark, sf, "clusters").select(F.col("member").alias("target_id"), F.col("rep").alias("cluster_id"))
    rows = rel(spark, sf, "annotated").join(named, "target_id")
    return community.site_cluster_counts(rows, max_sites=max_sites)


@query("opg1_site_cluster_counts", f"WITH {SITE_SQL} SELECT * FROM k", NEEDS)
def opg1(spark, sf):
    return sites(spark, sf)[0]


@query(
    "wn8_richest_sites",
    f"""WITH {SITE_SQL}, f AS (SELECT * FROM rw QUALIFY ROW_NUMBER() OVER (PARTITION BY site ORDER BY ord) = 1)
        SELECT site, richness, lat, lon, study, habitat, CASE WHEN lat <= -60 THEN 'Southern Ocean' WHEN lat >= 66 THEN 'Arctic Ocean' WHEN lat BETWEEN 30 AND 46 AND lon BETWEEN -6 AND 42 THEN 'Mediterranean/Black Sea'
               WHEN lon BETWEEN -70 AND 20 THEN 'Atlantic Ocean' WHEN lon > 20 AND lon <= 120 THEN 'Indian Ocean' ELSE 'Pacific Ocean' END AS ocean_basin FROM (SELECT * FROM rc ORDER BY richness DESC, site LIMIT 60) JOIN f USING (site)""",
    NEEDS,
)
def wn8(spark, sf):
    return sites(spark, sf, max_sites=60)[1]


DIST_SQL = f"""{SITE_SQL}, t AS (SELECT site, sum(n) AS s, count(*) AS c FROM k GROUP BY 1),
    sh AS (SELECT a.site AS site_a, b.site AS site_b, sum(least(a.n, b.n)) AS m, count(*) AS both_n FROM k a JOIN k b ON a.cluster_id = b.cluster_id AND a.site < b.site GROUP BY ALL),
    ds AS (SELECT x.site AS site_a, y.site AS site_b, coalesce(1 - 2.0*m/(x.s + y.s), 1) AS bray_curtis, coalesce(1 - both_n/(x.c + y.c - both_n), 1) AS jaccard
           FROM t x JOIN t y ON x.site < y.site LEFT JOIN sh ON sh.site_a = x.site AND sh.site_b = y.site)"""


@query("opg2_community_distances", f"WITH {DIST_SQL} SELECT site_a, site_b, round(bray_curtis, 6) AS bray_curtis, round(jaccard, 6) AS jaccard FROM ds WHERE jaccard < 1", NEEDS)
def opg2(spark, sf):
    """Pairs that share a cluster; every other pair is at distance 1."""
    return rounded(community.community_distances(sites(spark, sf)[0]), "bray_curtis", "jaccard")


def _distances(spark, sf):
    counts, meta = sites(spark, sf)
    return community.complete_pairs(community.community_distances(counts), meta.select("site"))


@query(
    "opg3_centred_distances",
    f"""WITH {DIST_SQL}, b AS (SELECT site_a AS i, site_b AS j, bray_curtis*bray_curtis AS q FROM ds UNION ALL SELECT site_b, site_a, bray_curtis*bray_curtis FROM ds UNION ALL SELECT site, site, 0 FROM t),
        m AS (SELECT i, avg(q) AS m FROM b GROUP BY 1) SELECT b.i AS site_a, b.j AS site_b, round(-0.5*(q - x.m - y.m + (SELECT avg(m) FROM m)), 6) + 0.0 AS b FROM b JOIN m x ON x.i = b.i JOIN m y ON y.i = b.j""",
    NEEDS,
)
def opg3_centred(spark, sf):
    return rounded(community.gower_centred(_distances(spark, sf), "bray_curtis"), "b").withColumn("b", F.col("b") + 0.0)


@query("opg3_principal_coordinates")
def opg3(spark, sf):
    return community.principal_coordinates(_distances(spark, sf), "bray_curtis")


@query(
    "opg4_mantel_test",
    f"""WITH {DIST_SQL}, od AS (SELECT perm, site, ROW_NUMBER() OVER (PARTITION BY perm ORDER BY substr(md5(site || '|' || perm || '|3'), 1, 15), site) AS pos FROM t, range(100) r(perm)),
        mv AS (SELECT o.perm, o.site, z.site AS dest FROM od o JOIN od z ON z.perm = 0 AND z.pos = o.pos WHERE o.perm > 0),
        pm AS (SELECT x.perm, d.bray_curtis AS va, least(x.dest, y.dest) AS p, greatest(x.dest, y.dest) AS q FROM ds d JOIN mv x ON x.site = d.site_a JOIN mv y ON y.site = d.site_b AND y.perm = x.perm),
        nl AS (SELECT perm, corr(va, e.jaccard) AS rp FROM pm JOIN ds e ON e.site_a = p AND e.site_b = q GROUP BY perm), ob AS (SELECT corr(bray_curtis, jaccard) AS r FROM ds)
        SELECT round(any_value(r), 6) AS r, round((count(*) FILTER (abs(rp) >= abs(r)) + 1) / (count(*) + 1), 6) AS p_value, count(*) AS n_permutations FROM nl, ob""",
    NEEDS,
)
def opg4(spark, sf):
    counts, meta = sites(spark, sf)
    found = community.mantel_test(community.community_distances(counts), meta, "bray_curtis", "jaccard", n_perm=99, seed=3, flat=float("nan"))
    return rounded(found, "r", "p_value")


@query("opg4_mantel_statistic", f"WITH {DIST_SQL} SELECT round(corr(bray_curtis, jaccard), 6) AS r FROM ds", NEEDS)
def opg4_r(spark, sf):
    counts, meta = sites(spark, sf)
    found = community.mantel_statistic(community.community_distances(counts), meta, "bray_curtis", "jaccard", flat=float("nan"))
    return rounded(found, "r")
