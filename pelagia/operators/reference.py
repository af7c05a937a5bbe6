"""Reference tables: ordered upserts, evidence and phenotype rows, the flattened master view, clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.functions.evidence import (
    GENERIC,
    function_evidence_level,
    normalized_phenotype,
    tier_rank,
)
from pelagia.functions.text import dedupe_tokens


def protein_id(accession: Column) -> Column:
    return F.concat_ws(":", F.lit("UNIPROT"), accession)


def local_protein_id(ec: Column, local_id: Column) -> Column:
    return F.concat_ws(":", F.lit("BRENDA"), ec, local_id)


# ---- ordered folds ---------------------------------------------------------------------


def ordered_token_union(rows: DataFrame, keys: Sequence[str], fields: Sequence[str], order: str) -> DataFrame:
    """Union of ``|`` separated tokens per key and field, in order of first arrival.

    Tokens are collapsed to their first position with map-side combine before any list is
    built, so a key with very many rows only ships its distinct tokens.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("_f"), F.col(f).alias("_v")) for f in fields])
    long = rows.select(*keys, order, F.inline(pairs)).where("_v IS NOT NULL")
    tokens = long.select(*keys, order, "_f", F.posexplode(F.split("_v", r"\|")).alias("_p", "_t")).where("_t <> ''")
    first = tokens.groupBy(*keys, "_f", "_t").agg(F.min(F.struct(F.col(order).alias("o"), F.col("_p").alias("p"))).alias("_at"))
    entry = F.struct("_at", "_t")

    def joined(field: str) -> Column:
        mine = F.array_sort(F.collect_list(F.when(F.col("_f") == field, entry)))
        return F.when(F.size(mine) > 0, F.array_join(F.transform(mine, lambda e: e["_t"]), "|")).alias(field)

    return first.groupBy(*keys).agg(*[joined(f) for f in fields])


def upsert_rows(
    existing: DataFrame | None,
    incoming: DataFrame,
    key: str,
    overwrite: Sequence[str] = (),
    keep_if_blank: Sequence[str] = (),
    union: Sequence[str] = (),
    order: str = "ord",
) -> DataFrame:
    """Existing and incoming rows folded by arrival order into one row per key.

    ``overwrite`` columns take the last value, ``keep_if_blank`` the last non-blank one,
    ``union`` columns collect tokens.  Existing rows come before every incoming one.
    """
    columns = [key, *overwrite, *keep_if_blank, *union]
    rows = incoming.select(*columns, order)
    if existing is not None:
        rows = existing.select(*columns, F.lit(-1).cast(rows.schema[order].dataType).alias(order)).unionByName(rows)
    aggs = []
    if overwrite:
        aggs.append(F.max_by(F.struct(*overwrite), order).alias("_o"))
    for column in keep_if_blank:
        blank = F.col(column).isNull() | (F.col(column) == "")
        aggs.append(F.max_by(column, F.when(~blank, F.col(order))).alias(column))
    folded = rows.groupBy(key).agg(*aggs, F.count(F.lit(1)).alias("_n"))
    out = folded.select(key, *(["_o.*"] if overwrite else []), *keep_if_blank)
    if union:
        out = out.join(ordered_token_union(rows, [key], union, order), key, "left")
    return out


def upsert_assignments(existing: DataFrame | None, incoming: DataFrame, order: str = "ord") -> DataFrame:
    """One row per (protein, family): reasons widen, the tier only improves, review is only ever cleared.

    The flag of the first row stands until a later row leaves the pair unambiguous.
    """
    keys = ["protein_id", "family"]
    fields = ["reason", "tier", "needs_manual_review", "subfamily", "confidence_notes"]
    rows = incoming.select(*keys, *fields, order)
    if existing is not None:
        rows = existing.select(*keys, *fields, F.lit(-1).cast(rows.schema[order].dataType).alias(order)).unionByName(rows)
    best = F.max_by("tier", tier_rank(F.col("tier")))
    named = F.col("subfamily").isNotNull() & (F.col("subfamily") != "")
    folded = rows.groupBy(*keys).agg(
        best.alias("tier"),
        F.min_by("needs_manual_review", order).alias("_first"),
        F.count(F.lit(1)).alias("_n"),
        F.min_by("subfamily", F.when(named, F.col(order))).alias("subfamily"),
    )
    cleared = (F.col("_n") > 1) & (F.col("tier") != "CANDIDATE_AMBIGUOUS")
    folded = folded.withColumn("needs_manual_review", F.when(cleared, F.lit(False)).otherwise(F.col("_first")))
    lists = ordered_token_union(rows, keys, ["reason", "confidence_notes"], order)
    return folded.drop("_first", "_n").join(lists, keys, "left")


def local_proteins(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Create-or-get rows for records without accession, with their source context stamped on."""
    stamped = incoming.select(
        local_protein_id(F.col("ec"), F.col("local_id")).alias("protein_id"),
        "organism",
        F.col("ec").alias("source_ec_numbers"),
        F.concat_ws(":", "ec", "local_id").alias("source_record_ids"),
        F.concat(F.lit("BRENDA:"), F.col("release")).alias("source_releases"),
        "ord",
    )
    unions = ["source_ec_numbers", "source_record_ids", "source_releases"]
    return upsert_rows(existing, stamped, "protein_id", keep_if_blank=["organism"], union=unions)


# ---- evidence and phenotype rows -------------------------------------------------------


def evidence_rows(hits: DataFrame, payload: Sequence[str]) -> DataFrame:
    """One evidence row per statement, the raw record kept as JSON."""
    return hits.select(
        "protein_id",
        F.col("source").alias("source_name"),
        F.col("record_id").alias("source_record_id"),
        F.when(F.size("pmids") > 0, F.array_join("pmids", "|")).alias("literature_pmids"),
        F.when(F.size("dois") > 0, F.array_join("dois", "|")).alias("literature_dois"),
        F.to_json(F.struct(*payload)).alias("raw_payload_json"),
        F.concat(F.lit("retrieval_reason="), F.col("reason")).alias("notes"),
    )


def phenotype_rows(proteins: DataFrame, monomers: dict, polymers: dict, blank: Sequence[str] = ()) -> DataFrame:
    """Function and catalytic-activity statements as normalized phenotype rows.

    A blank or NULL statement gives no row, unless its source field is one of ``blank``.
    """
    level = function_evidence_level(F.col("function_text"), monomers, polymers)
    statement = F.array(
        F.struct(
            F.lit("function_annotation").alias("phenotype_type"),
            F.lit("function").alias("source_field"),
            F.col("function_text").alias("text"),
            level.alias("level"),
        ),
        F.struct(
            F.lit("substrate_specificity").alias("phenotype_type"),
            F.lit("catalytic_activity").alias("source_field"),
            F.col("catalytic_activity_text").alias("text"),
            F.lit(GENERIC).alias("level"),
        ),
    )
    rows = proteins.select("protein_id", F.inline(statement))
    rows = rows.where((F.col("text").isNotNull() & (F.col("text") != "")) | F.col("source_field").isin(list(blank)))
    norm = normalized_phenotype(F.col("text"), F.col("level"), monomers, polymers)
    return rows.select("protein_id", "phenotype_type", "source_field", norm.alias("_n")).select(
        "protein_id", "phenotype_type", "source_field", "_n.*"
    )


def entries_for_record(entries: DataFrame, local_id: str = "local_id") -> DataFrame:
    """Statements opened to the record-local ids they cite."""
    return entries.select("*", F.explode("proteins").alias(local_id)).drop("proteins")


# ---- ingest plan -----------------------------------------------------------------------


def query_plan(families: DataFrame) -> DataFrame:
    """(family, query, reason): gene, name and (for broad families) EC terms × reviewed state.

    ``families`` has arrays ``genes`` and ``name_terms``, ``ec`` and ``broad_search``.
    """

    def terms(values: Column, kind: str, prefix: str, quote: str = "") -> Column:
        return F.transform(
            values,
            lambda t: F.struct(
                F.lit(kind).alias("kind"), F.concat(F.lit(prefix + quote), t, F.lit(quote)).alias("term")
            ),
        )

    empty = F.array().cast("array<string>")
    ec = F.when(F.col("broad_search") & F.col("ec").isNotNull(), F.array("ec")).otherwise(empty)
    every = F.concat(
        terms(F.coalesce("genes", empty), "gene_name", "gene:"),
        terms(F.coalesce("name_terms", empty), "protein_name", "protein_name:", '"'),
        terms(ec, "ec", "ec:"),
    )
    states = F.array(F.lit("true"), F.lit("false"))
    opened = families.select("family", F.inline(every)).select("*", F.explode(states).alias("_r"))
    label = F.when(F.col("_r") == "true", "uniprot_reviewed_").otherwise("uniprot_unreviewed_")
    return opened.select(
        "family",
        F.concat("term", F.lit(" AND reviewed:"), F.col("_r")).alias("query"),
        F.concat(label, F.col("kind")).alias("reason"),
    )


def shared_genes(families: DataFrame, allowed: Sequence[str] = ()) -> DataFrame:
    """Genes claimed by more than one family, apart from the one allowed group of families."""
    claims = families.select("family", F.explode("genes").alias("_g")).select("family", F.lower("_g").alias("gene"))
    owners = claims.groupBy("gene").agg(F.sort_array(F.collect_set("family")).alias("families"))
    permitted = F.array(*[F.lit(f) for f in sorted(allowed)]) if allowed else F.array().cast("array<string>")
    return owners.where((F.size("families") > 1) & (F.col("families") != permitted))


def accession_coverage(accessions: DataFrame, entries: DataFrame) -> DataFrame:
    """Requested, found and missing counts of a distinct accession list."""
    wanted = accessions.select("accession").where("accession <> ''").distinct()
    found = wanted.join(entries.select("accession").distinct().withColumn("_f", F.lit(1)), "accession", "left")
    return found.agg(
        F.count(F.lit(1)).alias("requested"),
        F.count("_f").alias("found"),
        (F.count(F.lit(1)) - F.count("_f")).alias("missing"),
    )


def run_log_row(rows: DataFrame, database: str, query: str, by: str) -> DataFrame:
    """One log row per family: database, query, number returned and status."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("number_returned")).select(
        F.lit(database).alias("database"), by, F.lit(query).alias("query"), "number_returned", F.lit("completed").alias("status")
    )


# ---- exact duplicates and cluster write-back -------------------------------------------


def family_members(proteins: DataFrame, assignments: DataFrame) -> DataFrame:
    """Family members that have a sequence."""
    known = proteins.where(F.col("sequence").isNotNull() & (F.col("sequence") != ""))
    return known.join(assignments, "protein_id")


def canonical_per_hash(members: DataFrame, by: Sequence[str] = ("family",)) -> DataFrame:
    """Best-tier then least id of every exact sequence, and how many members share it."""
    order = F.struct(-tier_rank(F.col("tier")), F.col("protein_id"))
    return members.groupBy(*by, "sequence_sha256").agg(
        F.min_by("protein_id", order).alias("canonical_id"), F.count(F.lit(1)).alias("n_members")
    )


def cluster_write_back(members: DataFrame, canonical: DataFrame, reps: DataFrame, by: str = "family") -> DataFrame:
    """Cluster id, representative and size for every member row of a clustered hash.

    Sizes are summed from the per-hash counts, so members are only joined, never regrouped.
    """
    placed = canonical.join(reps.select(F.col("member").alias("canonical_id"), F.col("rep")), "canonical_id")
    sizes = placed.groupBy(by, "rep").agg(F.sum("n_members").alias("cluster_size"))
    named = placed.join(sizes, [by, "rep"]).select(by, "sequence_sha256", "rep", "cluster_size")
    return members.join(named, [by, "sequence_sha256"]).select(
        "protein_id",
        by,
        F.concat_ws(":", by, "rep").alias("cluster_id"),
        F.col("rep").alias("cluster_representative"),
        "cluster_size",
    )
