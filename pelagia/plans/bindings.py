"""Stand-in relations: the domain tables expressed over the star-schema test tables.

Each relation is plain SQL that reads the same in Spark and in the checking engine,
so both sides start from identical inputs; everything after that point is written
twice, once with the operators and once as reference SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# Family order used for labels and matrices in the registered queries.
FAMILY_ORDER = ["phaA", "phaB", "phaC", "phaE", "phaG", "phaJ", "phaR_regulator"]

_FAMILY = (
    "CASE l_linenumber WHEN 1 THEN 'phaA' WHEN 2 THEN 'phaB' WHEN 3 THEN 'phaC' WHEN 4 THEN 'phaE' "
    "WHEN 5 THEN 'phaG' WHEN 6 THEN 'phaJ' ELSE 'phaR_regulator' END"
)

BINDINGS: dict[str, str] = {
    # one row per genome: taxonomy, place, depth, quality
    "facts": """
        SELECT CAST(c_custkey AS STRING) AS genome, r_name AS phylum, n_name AS genus,
               r_name || '-c' || CAST(c_custkey % 4 AS STRING) AS class_name,
               r_name || '-c' || CAST(c_custkey % 4 AS STRING) || '-o' || CAST(c_custkey % 20 AS STRING) AS order_name,
               r_name || '-f' || CAST(c_custkey % 60 AS STRING) AS family_name,
               n_name || ' sp' || CAST(c_custkey % 5 AS STRING) AS species,
               CASE WHEN c_custkey % 2 = 0 THEN 'Bacteria' ELSE 'Archaea' END AS domain_name,
               c_mktsegment AS habitat, 'ST' || CAST(c_custkey % 12 AS STRING) AS study,
               n_name || '/' || c_mktsegment AS sample_id,
               CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST((c_custkey * 37) % 181 - 90 AS DOUBLE) END AS lat,
               CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST((c_custkey * 53) % 361 - 180 AS DOUBLE) END AS lon,
               CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS depth_m,
               CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(50 + (c_custkey * 17) % 51 AS DOUBLE) END AS completeness,
               CAST((c_custkey * 13) % 101 AS DOUBLE) / 10 AS contamination
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
    """,
    # one row per alignment
    "hits": f"""
        SELECT CAST(l_suppkey AS STRING) AS query, CAST(l_partkey AS STRING) AS target, {_FAMILY} AS family,
               l_discount AS evalue, l_extendedprice AS bits, l_quantity * 2 AS pident,
               1 - l_discount AS qcov, 1 - l_tax * 5 AS tcov, CAST(l_quantity * 10 AS INT) AS alnlen,
               l_orderkey * 8 + l_linenumber AS ord
        FROM {{lineitem}}
    """,
    # target -> genome membership, with repeats
    "members": """
        SELECT CAST(l_partkey AS STRING) AS target, CAST(o_custkey AS STRING) AS genome, l_orderkey AS ord
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
    """,
    # cluster member -> representative
    "clusters": """
        SELECT CAST(p_partkey AS STRING) AS member, p_brand || '/' || p_type AS rep FROM {part}
    """,
    # one row per (target, genome) hit with genome facts: the annotated table
    "annotated": f"""
        SELECT CAST(l_partkey AS STRING) AS target_id, {_FAMILY} AS family, CAST(l_suppkey AS STRING) AS best_query,
               f.*, l_orderkey * 8 + l_linenumber AS ord
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
             JOIN {{facts}} f ON f.genome = CAST(o_custkey AS STRING)
    """,
    # the annotated table without the genome facts, which stand once per genome in "facts"
    "placed": f"""
        SELECT CAST(l_partkey AS STRING) AS target_id, {_FAMILY} AS family, CAST(l_suppkey AS STRING) AS best_query,
               CAST(o_custkey AS STRING) AS genome, l_orderkey * 8 + l_linenumber AS ord
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
    """,
    # wide membership rows: cluster, size, member list
    "membership": """
        SELECT 'T' || CAST(c_custkey AS STRING) AS target_id, 100 + c_custkey % 300 AS length, 4 AS size,
               'T' || CAST(c_custkey AS STRING) AS representative,
               'G' || CAST(c_custkey AS STRING) || '-scaffold_1_1;G' || CAST((c_custkey * 7) % 500 AS STRING)
               || '-scaffold_2_3;G' || CAST(c_custkey AS STRING) || '-scaffold_1_9;G'
               || CAST((c_custkey * 3) % 400 AS STRING) || '-scaffold_12_5' AS members
        FROM {customer}
    """,
    # climate grid: one-degree cells, depth levels, value
    "climate_grid": """
        SELECT CAST(l_orderkey % 180 AS DOUBLE) - 89.5 AS cell_lat,
               CAST(CAST(floor(l_orderkey / 180) AS BIGINT) * 7 % 360 AS DOUBLE) - 179.5 AS cell_lon,
               CAST((l_linenumber - 1) * 1500 AS DOUBLE) AS depth,
               max(CASE WHEN (l_partkey + l_linenumber) % 5 = 0 THEN NULL ELSE l_extendedprice / 20000 - l_linenumber END) AS value
        FROM {lineitem}
        GROUP BY CAST(l_orderkey % 180 AS DOUBLE) - 89.5,
                 CAST(CAST(floor(l_orderkey / 180) AS BIGINT) * 7 % 360 AS DOUBLE) - 179.5,
                 CAST((l_linenumber - 1) * 1500 AS DOUBLE)
    """,
    # excluded (family, query) pairs and excluded target ids
    "bad_queries": f"""
        SELECT DISTINCT {_FAMILY} AS family, CAST(l_suppkey AS STRING) AS best_query
        FROM {{lineitem}} WHERE (l_suppkey * 7 + l_linenumber) % 10 = 3
    """,
    "bad_targets": """
        SELECT CAST(p_partkey AS STRING) AS target FROM {part} WHERE p_size = 13
    """,
    # the four tables of the protein database; every line item is a row of one of the children
    "core_protein": """
        SELECT CAST(p_partkey AS STRING) AS protein_id,
               'P' || CAST(p_partkey AS STRING) AS uniprot_accession,
               p_type || '|' || p_brand || '|' || p_type AS secondary_accessions,
               CASE WHEN p_partkey % 3 = 0 THEN 'reviewed' ELSE 'unreviewed' END AS reviewed,
               p_name AS protein_name,
               CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type || '||' || p_type || '|' || p_name END AS alternative_protein_names,
               p_brand AS gene_name,
               CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand || '|c' || CAST(p_size % 7 AS STRING) END AS gene_synonyms,
               p_type AS organism,
               'c' || CAST(p_size % 7 AS STRING) AS strain,
               p_size * 10 AS ncbi_taxid,
               'root; ' || p_type AS taxonomic_lineage,
               CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE length(p_name || p_type) END AS sequence_length,
               'sha' || CAST(p_partkey % 97 AS STRING) AS sequence_sha256,
               CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_name || p_type END AS sequence,
               CAST(p_size % 5 AS STRING) || ': level' AS protein_existence,
               p_size % 6 AS annotation_score,
               '2.3.1.' || CAST(p_size AS STRING) || '|2.3.1.' || CAST(p_size AS STRING) AS ec_numbers,
               'RHEA:' || CAST(p_size * 100 AS STRING) AS rhea_ids,
               CASE WHEN p_partkey % 2 = 0 THEN p_name END AS function_text,
               p_type || ' = ' || p_brand AS catalytic_activity_text,
               'path ' || CAST(p_size % 11 AS STRING) AS pathway_text,
               CASE WHEN p_partkey % 6 = 0 THEN '1.1.1.36|1.1.1.36|2.3.1.9' END AS brenda_ec_numbers,
               CAST(p_size AS STRING) || '|' || CAST(p_size + 1 AS STRING) AS brenda_record_ids,
               'swissprot|uniprot|swissprot' AS brenda_sources,
               'R' || CAST(p_partkey % 3 AS STRING) || '|R' || CAST(p_size % 3 AS STRING) AS source_releases,
               '2025-01-0' || CAST(1 + p_partkey % 9 AS STRING) AS retrieved_at
        FROM {part}
    """,
    "core_assignment": """
        SELECT CAST(l_partkey AS STRING) AS protein_id, l_returnflag AS family_id,
               min(CASE WHEN l_suppkey % 3 = 0 THEN 'sub' || l_linestatus END) AS pha_subfamily,
               'gene_name|' || min(('m' || CAST(l_suppkey % 6 AS STRING))) || '|gene_name' AS retrieval_reasons, max(l_linestatus) || '_TIER' AS evidence_tier,
               l_returnflag || ':' || CAST(l_partkey % 50 AS STRING) AS cluster95_id, CAST(l_partkey % 50 AS STRING) AS cluster95_representative,
               count(*) AS cluster95_size
        FROM {lineitem} WHERE l_linenumber IN (3, 6, 7)
        GROUP BY l_partkey, l_returnflag
    """,
    "core_evidence": """
        SELECT CAST(l_partkey AS STRING) AS protein_id, CASE WHEN l_tax > CAST(0.05 AS DOUBLE) THEN '' ELSE CAST(l_suppkey AS STRING) END AS literature_pmids,
               CASE WHEN l_linenumber = 4 THEN l_linestatus || '/' || CAST(l_suppkey % 7 AS STRING) END AS literature_dois
        FROM {lineitem} WHERE l_linenumber IN (1, 4)
    """,
    "core_phenotype": """
        SELECT CAST(l_partkey AS STRING) AS protein_id,
               CASE WHEN l_suppkey % 2 = 0 THEN 'substrate_specificity' ELSE 'other' END AS phenotype_type,
               ('m' || CAST(l_suppkey % 6 AS STRING)) || ' ' || l_returnflag AS phenotype_raw,
               CASE WHEN l_tax > CAST(0.04 AS DOUBLE) THEN 'M' || CAST(l_linenumber AS STRING) || '|M' || CAST(l_suppkey % 3 AS STRING) END AS demonstrated_monomers,
               CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'PH' || l_returnflag END AS demonstrated_polymers,
               ('m' || CAST(l_suppkey % 6 AS STRING)) AS composition_text,
               l_returnflag || '_level' AS phenotype_evidence_level,
               CAST(l_suppkey % 10 AS STRING) AS literature_pmids,
               CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_linestatus || '/' || CAST(l_suppkey % 7 AS STRING) END AS literature_dois,
               CASE WHEN l_suppkey % 5 = 0 THEN CAST(20 + l_suppkey % 40 AS STRING) END AS temperature_optimum,
               CASE WHEN l_suppkey % 6 = 0 THEN '10-' || CAST(30 + l_suppkey % 9 AS STRING) ELSE '' END AS temperature_range,
               CASE WHEN l_suppkey % 7 = 1 THEN ('m' || CAST(l_suppkey % 6 AS STRING)) END AS temperature_stability,
               CAST(5 + l_suppkey % 5 AS STRING) AS ph_optimum,
               CASE WHEN l_suppkey % 8 = 3 THEN '6-' || CAST(7 + l_suppkey % 3 AS STRING) END AS ph_range,
               CASE WHEN l_suppkey % 9 = 2 THEN CAST(l_suppkey AS STRING) END AS specific_activity
        FROM {lineitem} WHERE l_linenumber IN (2, 5)
    """,
}



def spark_relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in relation as a DataFrame over the parquet tables in ``sf_dir``."""
    return spark.sql(_expand(BINDINGS[name], sf_dir))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _expand(template: str, sf_dir: str) -> str:
    def put(match: re.Match) -> str:
        name = match.group(1)
        if name in BINDINGS:
            return "(" + _expand(BINDINGS[name], sf_dir) + ")"
        return f"parquet.`{sf_dir}/{name}.parquet`"

    return re.sub(r"\{(\w+)\}", put, template)


def _needed(names: tuple[str, ...]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for child in re.findall(r"\{(\w+)\}", BINDINGS[name]):
            if child in BINDINGS:
                visit(child)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def with_bindings(sql: str, uses: tuple[str, ...]) -> str:
    """Prefix ``sql`` with the stand-in relations it uses, as common table expressions."""
    parts = [f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', BINDINGS[n]).strip()})" for n in _needed(uses)]
    if not parts:
        return sql.strip()
    body = sql.strip()
    match = re.match(r"(?i)with\s+(recursive\s+)?", body)
    if match:
        return f"WITH {match.group(1) or ''}" + ", ".join(parts) + ", " + body[match.end():]
    return "WITH " + ", ".join(parts) + " " + body
