"""Registered queries: joins that enrich targets, verdicts, chords, manifests."""

from __future__ import annotations

from pelagia.operators import enrich as ops
from pelagia.operators import graph
from pelagia.plans.common import MATRIX_SQL, F, family_matrix, rel, rounded, table
from pelagia.plans.registry import query

CAP_SQL = """ex AS (SELECT target_id, size, split_part(m, '-scaffold_', 1) AS genome
      FROM (SELECT target_id, size, unnest(string_split(members, ';')) AS m FROM membership) WHERE contains(m, '-scaffold_')),
    dg AS (SELECT target_id, size, genome, ROW_NUMBER() OVER (PARTITION BY target_id ORDER BY genome) AS rn,
           count(*) OVER (PARTITION BY target_id) AS total FROM (SELECT DISTINCT target_id, size, genome FROM ex))"""
WANTED = "SELECT 'T' || CAST(c_custkey AS VARCHAR) AS target_id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"


def wanted(spark, sf):
    return table(spark, sf, "customer").where("c_mktsegment IN ('BUILDING', 'MACHINERY')").select(
        F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("target_id")
    )


@query(
    "jn3_wanted_semi_join",
    """SELECT target_id, genome, family, ord FROM annotated WHERE target_id IN (SELECT target FROM bad_targets)""",
    ("annotated", "bad_targets"),
)
def jn3(spark, sf):
    ids = rel(spark, sf, "bad_targets").withColumnRenamed("target", "target_id")
    return ops.wanted_only(rel(spark, sf, "annotated"), ids, "target_id").select("target_id", "genome", "family", "ord")


@query(
    "wn4_capped_genomes_per_target",
    f"""WITH {CAP_SQL}, w AS ({WANTED}) SELECT target_id, CAST(any_value(size) AS INT) AS n_members, CAST(any_value(total) AS INT) AS n_genomes_total,
        string_agg(genome, ',' ORDER BY genome) FILTER (rn <= 2) AS genomes FROM dg JOIN w USING (target_id) GROUP BY target_id""",
    ("membership",),
)
def wn4(spark, sf):
    out = ops.capped_target_genomes(rel(spark, sf, "membership"), wanted(spark, sf), cap=2)
    return out.withColumn("genomes", F.array_join("genomes", ","))


@query(
    "src4_all_target_genomes",
    f"WITH {CAP_SQL}, w AS ({WANTED}) SELECT target_id, genome FROM dg JOIN w USING (target_id)",
    ("membership",),
)
def src4(spark, sf):
    return ops.all_target_genomes(rel(spark, sf, "membership"), wanted(spark, sf))


ENRICH_SQL = f"""{CAP_SQL}, t AS (SELECT 'T' || CAST(c_custkey AS VARCHAR) AS target_id, c_acctbal AS bits FROM customer
        UNION ALL SELECT 'T' || CAST(-1 - s_suppkey AS VARCHAR), s_acctbal FROM supplier),
    gm AS (SELECT 'G' || genome AS genome, phylum, genus, sample_id FROM facts WHERE CAST(genome AS BIGINT) % 10 <> 0),
    sm AS (SELECT DISTINCT n_name || '/' || c_mktsegment AS sample_id, c_mktsegment AS ecosystem
           FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 6 <> 2),
    e AS (SELECT t.target_id, bits, CAST(size AS INT) AS n_members, CAST(total AS INT) AS n_genomes_total,
            CAST(coalesce(total, 0) AS INT) AS n_genomes_shown, dg.genome, CAST(rn AS INT) AS genome_index,
            phylum, genus, gm.sample_id, ecosystem, gm.genome IS NOT NULL AS genome_metadata_found, sm.sample_id IS NOT NULL AS sample_metadata_found
          FROM t LEFT JOIN dg ON dg.target_id = t.target_id
          LEFT JOIN gm ON gm.genome = dg.genome LEFT JOIN sm ON sm.sample_id = gm.sample_id)"""


def _enriched(spark, sf):
    customers = table(spark, sf, "customer")
    targets = customers.select(F.concat(F.lit("T"), F.col("c_custkey")).alias("target_id"), F.col("c_acctbal").alias("bits"))
    extra = table(spark, sf, "supplier").select(
        F.concat(F.lit("T"), -1 - F.col("s_suppkey")).alias("target_id"), F.col("s_acctbal").alias("bits")
    )
    targets = targets.unionByName(extra)
    capped = ops.capped_target_genomes(rel(spark, sf, "membership"), targets)
    genomes = rel(spark, sf, "facts").where(F.col("genome").cast("long") % 10 != 0)
    genomes = genomes.select(F.concat(F.lit("G"), "genome").alias("genome"), "phylum", "genus", "sample_id")
    samples = customers.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    samples = samples.where("n_nationkey % 6 <> 2").select(
        F.concat_ws("/", "n_name", "c_mktsegment").alias("sample_id"), F.col("c_mktsegment").alias("ecosystem")
    )
    return ops.enrich_targets(targets, capped, genomes, samples.distinct())


@query("jn6_enriched_targets", f"WITH {ENRICH_SQL} SELECT * FROM e", ("membership", "facts"))
def jn6(spark, sf):
    return _enriched(spark, sf)


@query(
    "jn6_enrichment_counts",
    f"""WITH {ENRICH_SQL} SELECT count(*) AS n_output_rows, count(DISTINCT target_id) AS n_target_ids,
        count(DISTINCT CASE WHEN genome IS NOT NULL THEN target_id END) AS n_targets_matched, count(DISTINCT genome) AS n_genomes_needed,
        count(DISTINCT CASE WHEN genome_metadata_found THEN genome END) AS n_genomes_resolved,
        count(DISTINCT CASE WHEN sample_metadata_found THEN sample_id END) AS n_samples_resolved FROM e""",
    ("membership", "facts"),
)
def jn6_counts(spark, sf):
    return ops.enrichment_counts(_enriched(spark, sf))


@query(
    "wn5_genome_index",
    f"WITH {CAP_SQL} SELECT target_id, genome, CAST(rn AS INT) AS genome_index FROM dg",
    ("membership",),
)
def wn5(spark, sf):
    rows = rel(spark, sf, "membership")
    capped = ops.capped_target_genomes(rows, rows.select("target_id"))
    opened = capped.select("target_id", F.posexplode("genomes").alias("_p", "genome"))
    return opened.select("target_id", "genome", (F.col("_p") + 1).alias("genome_index"))


DEPTH_TEXT = """CASE CAST(event_id % 11 AS INT) WHEN 0 THEN CAST(round(value, 1) AS STRING) || ' m' WHEN 1 THEN CAST(round(value, 1) AS STRING)
    WHEN 2 THEN 'Surface water' WHEN 3 THEN '10-' || CAST(round(value, 1) AS STRING) || ' m' WHEN 4 THEN '10 to ' || CAST(round(value, 1) AS STRING) || ' m'
    WHEN 5 THEN '-2 m' WHEN 6 THEN 'not collected' WHEN 7 THEN CAST(event_id AS STRING) || 'cm' WHEN 8 THEN '5 cm deep'
    WHEN 9 THEN '' ELSE 'depth ' || CAST(event_id AS STRING) || 'm' END"""
RANGE_RE = r"(?i)(-?\d+(?:\.\d+)?)\s*m?\s*(?:-|to)\s*(-?\d+(?:\.\d+)?)\s*m?"
SINGLE_RE = r"(?i)(-?\d+(?:\.\d+)?)\s*m?\b"
DEPTH_M_SQL = rf"""CASE WHEN raw IS NULL OR trim(raw) = '' OR lower(trim(raw)) IN ('not collected','not applicable','missing','n/a','na','not provided','unknown','restricted access') THEN NULL
    WHEN regexp_matches(raw, '(?i)surface') THEN 0.0
    WHEN regexp_matches(raw, '{RANGE_RE}') THEN (CAST(regexp_extract(raw, '{RANGE_RE}', 1) AS DOUBLE) + CAST(regexp_extract(raw, '{RANGE_RE}', 2) AS DOUBLE)) / 2
    ELSE TRY_CAST(nullif(regexp_extract(raw, '{SINGLE_RE}', 1), '') AS DOUBLE) END"""
ZONE_OF_M = """CASE WHEN depth_m IS NULL THEN '' WHEN greatest(depth_m, 0) < 50 THEN '0-50m' WHEN depth_m < 200 THEN '50-200m'
    WHEN depth_m < 1000 THEN '200-1000m' WHEN depth_m < 4000 THEN '1000-4000m' ELSE '>4000m' END"""
DEPTH_SQL = DEPTH_TEXT.replace("STRING", "VARCHAR")


@query(
    "jn7_depth_by_sample",
    f"""WITH d AS (SELECT event_id, {DEPTH_SQL} AS raw FROM events),
        r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'Unknown_biosample' ELSE 'S' || CAST(o_orderkey AS VARCHAR) END AS biosample FROM orders),
        j AS (SELECT r.*, d.raw FROM r LEFT JOIN d ON r.biosample <> 'Unknown_biosample' AND r.o_orderkey = d.event_id),
        m AS (SELECT o_orderkey, biosample, coalesce(raw, '') AS depth_raw, {DEPTH_M_SQL} AS depth_m FROM j)
        SELECT o_orderkey, biosample, depth_raw, depth_m, {ZONE_OF_M} AS depth_zone FROM m""",
)
def jn7(spark, sf):
    depths = table(spark, sf, "events").select(
        F.concat(F.lit("S"), F.col("event_id").cast("string")).alias("biosample"), F.expr(DEPTH_TEXT).alias("depth_raw")
    )
    extra = depths.limit(1).select(F.lit("Unknown_biosample").alias("biosample"), F.lit("7 m").alias("depth_raw"))
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 10 = 0 THEN 'Unknown_biosample' ELSE 'S' || CAST(o_orderkey AS STRING) END AS biosample"
    )
    return ops.enrich_depth(rows, depths.unionByName(extra))


@query(
    "f4_depth_text_to_metres",
    f"WITH d AS (SELECT event_id, {DEPTH_SQL} AS raw FROM events) SELECT event_id, raw, {DEPTH_M_SQL} AS depth_m FROM d",
)
def f4(spark, sf):
    from pelagia.functions.text import depth_in_metres

    rows = table(spark, sf, "events").select("event_id", F.expr(DEPTH_TEXT).alias("raw"))
    return rows.withColumn("depth_m", depth_in_metres(F.col("raw")))


@query(
    "jn9_anchor_sequences_by_genome",
    """SELECT DISTINCT genome, text AS sequence FROM members JOIN documents ON CAST(doc_id AS VARCHAR) = target WHERE text <> ''""",
    ("members",),
)
def jn9(spark, sf):
    from pelagia.operators.neighborhood import anchor_sequences

    sequences = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("target"), F.col("text").alias("sequence"))
    return anchor_sequences(rel(spark, sf, "members"), sequences)


@query(
    "jn11_prediction_chain",
    """WITH m AS (SELECT target_id, arg_min(genome, ord) AS genome, arg_min(genus, ord) AS genus, arg_min(depth_m, ord) AS depth_m FROM
          (SELECT target_id, genome, genus, coalesce(depth_m, -9999) AS depth_m, ord FROM annotated) GROUP BY target_id)
       SELECT CAST(p_partkey AS VARCHAR) AS target_id, p_size AS predicted, m.genome, genus, m.depth_m, c_acctbal AS temp, d.n_chars AS raw_length
       FROM part LEFT JOIN m ON m.target_id = CAST(p_partkey AS VARCHAR)
       LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON CAST(c_custkey AS VARCHAR) = m.genome
       LEFT JOIN documents d ON CAST(doc_id AS VARCHAR) = CAST(p_partkey AS VARCHAR)""",
    ("annotated",),
)
def jn11(spark, sf):
    predictions = table(spark, sf, "part").selectExpr("CAST(p_partkey AS STRING) AS protein_id", "p_size AS predicted")
    id_col = ops.detect_id_column(predictions.columns)
    metadata = rel(spark, sf, "annotated").withColumn("depth_m", F.coalesce("depth_m", F.lit(-9999.0)))
    climate = table(spark, sf, "customer").where("c_custkey % 2 = 0").selectExpr("CAST(c_custkey AS STRING) AS genome", "c_acctbal AS temp")
    manifest = table(spark, sf, "documents").selectExpr("CAST(doc_id AS STRING) AS target_id", "n_chars AS raw_length")
    return ops.first_row_lookup_chain(
        predictions.withColumnRenamed(id_col, "target_id"), metadata, climate, manifest, ["genome", "genus", "depth_m"]
    )


NORM = "regexp_replace(replace(text, '*', ''), 'X+$', '')"


@query(
    "jn12_candidate_verdicts",
    f"""WITH known AS (SELECT CAST(min(doc_id) AS VARCHAR) AS t, {NORM} AS s FROM documents WHERE doc_id % 2 = 0 GROUP BY 2),
        cand AS (SELECT doc_id, {NORM} AS s, 'g' || CAST(doc_id % 50 AS VARCHAR) AS genome FROM documents WHERE doc_id % 3 = 0)
        SELECT CAST(doc_id AS VARCHAR) AS gene_id, cand.genome, coalesce(known.t, '') AS matched_target,
               CASE WHEN known.t IS NULL THEN 'new' WHEN CAST(known.t AS BIGINT) % 5 = 0 THEN 'known_qc_removed' ELSE 'known_qc_passing' END AS verdict,
               CAST(substr(cand.genome, 2) AS INT) < 20 AS genome_has_qc_passing
        FROM cand LEFT JOIN known ON known.s = cand.s""",
)
def jn12(spark, sf):
    docs = table(spark, sf, "documents")
    targets = docs.where("doc_id % 2 = 0").select(F.format_string("%08d", "doc_id").alias("target_id"), F.col("text").alias("sequence"))
    bad = docs.where("doc_id % 5 = 0").select(F.format_string("%08d", "doc_id").alias("target_id"))
    candidates = docs.where("doc_id % 3 = 0").selectExpr(
        "CAST(doc_id AS STRING) AS gene_id", "text AS sequence", "concat('g', doc_id % 50) AS genome"
    )
    carriers = docs.where("doc_id % 50 < 20").selectExpr("concat('g', doc_id % 50) AS genome")
    out = ops.candidate_verdicts(candidates, targets, bad, carriers)
    plain = F.when(F.col("matched_target") == "", "").otherwise(F.col("matched_target").cast("long").cast("string"))
    return out.withColumn("matched_target", plain)


@query(
    "jn13_near_duplicates_within_genomes",
    """WITH l AS (SELECT DISTINCT target, genome FROM members), p AS (SELECT h.*, a.genome FROM hits h JOIN l a ON a.target = h.query
          JOIN l b ON b.target = h.target AND b.genome = a.genome WHERE h.query <> h.target)
       SELECT p.genome, count(*) AS n_pairs, count(*) FILTER (pident >= 95) AS n_near_duplicate,
              round(100.0 * count(*) FILTER (pident >= 95) / count(*), 6) AS pct_near_duplicate, round(median(pident), 6) AS median_pident
       FROM p GROUP BY p.genome""",
    ("hits", "members"),
)
def jn13(spark, sf):
    from pelagia.operators.ordering import exact_medians

    pairs = ops.shared_genome_pairs(rel(spark, sf, "hits"), rel(spark, sf, "members"))
    medians = exact_medians(pairs, ["genome"], {"median_pident": F.col("pident")})
    return rounded(ops.near_duplicate_share(pairs).join(medians, "genome"), "pct_near_duplicate", "median_pident")


COPIES_SQL = """cp AS (SELECT DISTINCT rep AS cluster_id, genome, target AS target_id FROM members JOIN clusters ON member = target)"""


def copies(spark, sf):
    named = rel(spark, sf, "clusters").select(F.col("member").alias("target"), F.col("rep").alias("cluster_id"))
    return rel(spark, sf, "members").join(named, "target").select("cluster_id", "genome", F.col("target").alias("target_id")).distinct()


@query(
    "jn14_chords_per_cluster",
    f"""WITH {COPIES_SQL} SELECT a.cluster_id, any_value(n) AS n_copies, count(*) AS n_chords FROM cp a
        JOIN cp b ON a.cluster_id = b.cluster_id AND a.genome <> b.genome AND (a.genome, a.target_id) < (b.genome, b.target_id)
        JOIN (SELECT cluster_id, count(*) AS n FROM cp GROUP BY 1) c ON c.cluster_id = a.cluster_id GROUP BY a.cluster_id""",
    ("members", "clusters"),
)
def jn14(spark, sf):
    return ops.cluster_chord_totals(copies(spark, sf))


@query(
    "jn14_chords_of_one_genome",
    f"""WITH {COPIES_SQL} SELECT b.cluster_id, b.genome, a.target_id AS target_a, b.target_id AS target_b FROM cp a
        JOIN cp b ON a.cluster_id = b.cluster_id AND b.genome <> '7' WHERE a.genome = '7'""",
    ("members", "clusters"),
)
def jn14_one(spark, sf):
    return ops.genome_chords(copies(spark, sf), "7").select("cluster_id", "genome", "target_a", "target_b")


@query(
    "jn21_agreeing_single_copy_genomes",
    f"""WITH {MATRIX_SQL}, b AS (SELECT genome FROM members WHERE target IN (SELECT target FROM bad_targets) GROUP BY genome HAVING count(DISTINCT target) = 1),
        a AS (SELECT genome FROM matrix WHERE n_phaC = 3)
        SELECT coalesce(a.genome, b.genome) AS genome, CASE WHEN b.genome IS NULL THEN 'matrix_only' WHEN a.genome IS NULL THEN 'membership_only' ELSE 'both' END AS status
        FROM a FULL JOIN b ON a.genome = b.genome""",
    ("annotated", "bad_queries", "members", "bad_targets"),
)
def jn21(spark, sf):
    links = rel(spark, sf, "members").join(rel(spark, sf, "bad_targets"), "target", "left_semi")
    matrix = family_matrix(spark, sf).withColumn("single", (F.col("n_phaC") == 3).cast("int"))
    return ops.agreeing_single_copy(matrix, links, "single")


@query(
    "jn22_hybrid_triad_flag",
    """SELECT CAST(p_partkey AS VARCHAR) AS target_id, CASE WHEN p_partkey % 3 = 0 THEN p_size > 25 WHEN p_partkey % 3 = 1 THEN p_retailprice > 1000 ELSE false END AS flag,
              CASE WHEN p_partkey % 3 = 0 THEN 'structural' WHEN p_partkey % 3 = 1 THEN 'alignment' ELSE 'none' END AS origin FROM part""",
)
def jn22(spark, sf):
    part = table(spark, sf, "part").withColumn("target_id", F.col("p_partkey").cast("string"))
    structural = part.where("p_partkey % 3 = 0").withColumn("flag", F.col("p_size") > 25)
    aligned = part.where("p_partkey % 3 <= 1").withColumn("flag", F.col("p_retailprice") > 1000)
    return ops.hybrid_flag(part, structural, aligned)


@query(
    "jn23_shared_gene_disambiguation",
    """WITH d AS (SELECT doc_id, contains(lower(text), 'the ') AS f, contains(lower(text), ' la ') AS s FROM documents)
       SELECT doc_id, family, f = s AS needs_manual_review, CASE WHEN f = s THEN 'unclear' END AS confidence_notes FROM (
         SELECT doc_id, f, s, unnest(CASE WHEN f AND NOT s THEN ['phaR_synthase'] WHEN s AND NOT f THEN ['phaR_regulator'] ELSE ['phaR_synthase', 'phaR_regulator'] END) AS family FROM d)""",
)
def jn23(spark, sf):
    docs = table(spark, sf, "documents")
    out = ops.disambiguate(docs, F.col("text"), [("phaR_synthase", ["The "]), ("phaR_regulator", [" la "])], "unclear")
    return out.select("doc_id", "family", "needs_manual_review", "confidence_notes")


@query(
    "jn24_representative_scores",
    """WITH sizes AS (SELECT rep AS cluster_id, count(*) AS n FROM clusters GROUP BY 1)
       SELECT CAST(p_partkey AS VARCHAR) AS target_id, i.pident, p_retailprice AS structure_score, p_partkey % 5 = 0 AND p_size > 20 AS triad_complete,
              c.rep AS cluster_id, coalesce(s.n, 1) AS n_genomes_in_cluster
       FROM part JOIN (SELECT target, max(pident) AS pident FROM hits GROUP BY target) i ON i.target = CAST(p_partkey AS VARCHAR)
       LEFT JOIN (SELECT * FROM clusters WHERE CAST(member AS BIGINT) % 7 <> 0) c ON c.member = CAST(p_partkey AS VARCHAR)
       LEFT JOIN sizes s ON s.cluster_id = c.rep WHERE p_partkey % 2 = 0""",
    ("hits", "clusters"),
)
def jn24(spark, sf):
    part = table(spark, sf, "part").withColumn("target_id", F.col("p_partkey").cast("string"))
    identity = rel(spark, sf, "hits").groupBy(F.col("target").alias("target_id")).agg(F.max("pident").alias("pident"))
    structure = part.where("p_partkey % 2 = 0").select("target_id", F.col("p_retailprice").alias("structure_score"))
    flags = part.where("p_partkey % 5 = 0").select("target_id", (F.col("p_size") > 20).alias("flag"))
    clusters = rel(spark, sf, "clusters")
    sizes = clusters.groupBy(F.col("rep").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n_genomes"))
    named = clusters.where(F.col("member").cast("long") % 7 != 0)
    return ops.representative_table(part.select("target_id"), identity, structure, flags, named, sizes)


@query(
    "jn25_genome_catalogue_with_samples",
    """SELECT genome, phylum, f.sample_id, ecosystem, CASE WHEN s.sample_id IS NULL THEN 'no' ELSE 'yes' END AS sample_found
       FROM facts f LEFT JOIN (SELECT DISTINCT sample_id, habitat AS ecosystem FROM facts WHERE genus <> 'NATION_2') s ON s.sample_id = f.sample_id""",
    ("facts",),
)
def jn25(spark, sf):
    facts = rel(spark, sf, "facts")
    samples = facts.where("genus <> 'NATION_2'").select("sample_id", F.col("habitat").alias("ecosystem")).distinct()
    return ops.catalogue_with_samples(facts.select("genome", "phylum", "sample_id"), samples)


QUAL_SQL = "q AS (SELECT genome FROM matrix WHERE n_phaC = 0 AND n_families_present > 4)"


@query(
    "jn26_recovery_anchors",
    f"""WITH {MATRIX_SQL}, {QUAL_SQL} SELECT genome, family, target_id FROM annotated WHERE family IN ('phaA', 'phaB', 'phaG') AND genome IN (SELECT genome FROM q)""",
    ("annotated", "bad_queries"),
)
def jn26(spark, sf):
    from pelagia.operators.audit import qualifying_genomes

    rows = rel(spark, sf, "annotated")
    qualifying = qualifying_genomes(family_matrix(spark, sf), "n_phaC", 4)
    return ops.anchor_rows(qualifying, {f: rows.where(F.col("family") == f) for f in ("phaA", "phaB", "phaG")})


@query(
    "jn26_download_manifest",
    f"""WITH {MATRIX_SQL}, {QUAL_SQL} SELECT genome, 'file:///genomes/' || genome || '.faa' AS address FROM facts WHERE genome IN (SELECT genome FROM q)""",
    ("annotated", "bad_queries"),
)
def jn26_manifest(spark, sf):
    from pelagia.operators.audit import qualifying_genomes

    qualifying = qualifying_genomes(family_matrix(spark, sf), "n_phaC", 4)
    return ops.download_manifest(qualifying, rel(spark, sf, "facts"), "file:///genomes/", ".faa")


@query(
    "src17_lookup_chunks",
    """SELECT key, (ROW_NUMBER() OVER (ORDER BY key) - 1) // 100 AS chunk FROM (SELECT DISTINCT o_custkey AS key FROM orders)""",
)
def src17(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"))
    return ops.chunk_of_ids(ids, "key", 100, F.expr("key DIV 65536"))


@query(
    "src17_lookup_by_key",
    """SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) ON c_custkey = o_custkey""",
)
def src17_lookup(spark, sf):
    dimension = table(spark, sf, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return ops.lookup(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), dimension, "o_custkey")


# Similarity edges: hits of one id on another that pass the identity and coverage cuts.
EDGE_SQL = """e AS (SELECT query AS a, target AS b FROM hits WHERE pident >= 95 AND qcov >= 0.9 AND tcov >= 0.9 AND query <> target)"""


@query(
    "opg6_near_duplicate_components",
    f"""WITH RECURSIVE {EDGE_SQL}, u AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)),
        r(node, comp) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, r.comp FROM r JOIN u ON u.a = r.node)
        SELECT node, min(comp) AS component FROM r GROUP BY node""",
    ("hits",),
)
def opg6(spark, sf):
    edges = graph.similarity_edges(rel(spark, sf, "hits"))
    return graph.connected_components(edges)


@query(
    "opg6_collapsed_to_longest",
    f"""WITH RECURSIVE {EDGE_SQL}, u AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)),
        r(node, comp) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, r.comp FROM r JOIN u ON u.a = r.node),
        c AS (SELECT node, min(comp) AS component FROM r GROUP BY node),
        m AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_size, coalesce(component, CAST(p_partkey AS VARCHAR)) AS component FROM part LEFT JOIN c ON c.node = CAST(p_partkey AS VARCHAR))
        SELECT component, first(id ORDER BY p_size DESC, id) AS representative, count(*) AS n_members FROM m GROUP BY component""",
    ("hits",),
)
def opg6_longest(spark, sf):
    edges = graph.similarity_edges(rel(spark, sf, "hits"))
    nodes = table(spark, sf, "part").selectExpr("CAST(p_partkey AS STRING) AS id", "p_size")
    labelled = graph.component_of_all(nodes, graph.connected_components(edges), "id")
    return graph.longest_member(labelled, "component", "id", "p_size")


@query(
    "tk4_longest_member",
    """SELECT p_brand, first(id ORDER BY p_size DESC, id) AS representative, count(*) AS n_members FROM (SELECT p_brand, p_size, CAST(p_partkey AS VARCHAR) AS id FROM part) GROUP BY p_brand""",
)
def tk4(spark, sf):
    return graph.longest_member(table(spark, sf, "part").selectExpr("p_brand", "p_size", "CAST(p_partkey AS STRING) AS id"), "p_brand", "id", "p_size")


@query(
    "tk4_preferred_representative",
    """SELECT p_brand, CASE WHEN bool_or(id = g) THEN max(g) ELSE min(id) END AS representative, count(*) AS n_members FROM (
         SELECT p_brand, CAST(p_partkey AS VARCHAR) AS id, CAST(length(p_brand) * 11 AS VARCHAR) AS g FROM part) GROUP BY p_brand""",
)
def tk4_preferred(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_brand", "CAST(p_partkey AS STRING) AS id", "CAST(length(p_brand) * 11 AS STRING) AS g")
    return graph.preferred_representative(rows, "p_brand", "id", "g")
