"""The master table: one row per (protein, family), every child folded into text cells, columns checked before writing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.functions.text import dedupe_tokens
from pelagia.sources.schemas import MASTER_COLUMNS, MASTER_TOKEN_COLUMNS

# Master column <- column of the family assignment, where the names differ.
ASSIGNMENT_NAMES = {"pha_family": "family_id", "retrieval_reason": "retrieval_reasons"}
ASSIGNMENT_COLUMNS = ["pha_family", "pha_subfamily", "retrieval_reason", "evidence_tier", "cluster95_id", "cluster95_representative", "cluster95_size"]
EVIDENCE_COLUMNS = ["literature_pmids", "literature_dois"]
# Master column <- phenotype column, where the names differ; blank values do not count.
PHENOTYPE_NAMES = {"polymer_composition_text": "composition_text"}
PHENOTYPE_COLUMNS = [
    "demonstrated_monomers", "demonstrated_polymers", "polymer_composition_text", "temperature_optimum", "temperature_range",
    "temperature_stability", "ph_optimum", "ph_range", "specific_activity",
]
DERIVED_COLUMNS = ["substrate_specificity_text", "phenotype_evidence_level", "phenotype_references"]
PROTEIN_COLUMNS = [c for c in MASTER_COLUMNS if c not in {*ASSIGNMENT_COLUMNS, *EVIDENCE_COLUMNS, *PHENOTYPE_COLUMNS, *DERIVED_COLUMNS}]


def require_columns(df: DataFrame, names: Sequence[str], what: str) -> DataFrame:
    """``df`` as it is; an error that lists what is missing if it lacks one of ``names``."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    return df


def distinct_text(value: Column, blanks: bool = False) -> Column:
    """Sorted distinct values joined by ``|``, NULL when there are none; without ``blanks`` empty ones do not count."""
    found = F.sort_array(F.collect_set(value if blanks else F.when(value != "", value)))
    return F.when(F.size(found) > 0, F.array_join(found, "|"))


def evidence_texts(evidence: DataFrame) -> DataFrame:
    """Literature ids of a protein's evidence rows."""
    require_columns(evidence, ["protein_id", *EVIDENCE_COLUMNS], "evidence")
    return evidence.groupBy("protein_id").agg(*[distinct_text(F.col(c)).alias(c) for c in EVIDENCE_COLUMNS])


def phenotype_texts(phenotypes: DataFrame) -> DataFrame:
    """The twelve text cells of a protein's phenotype rows.

    References are the distinct ids of both kinds; substrate statements are those of that type; levels count as they
    are, blank ones too.
    """
    given = {c: PHENOTYPE_NAMES.get(c, c) for c in PHENOTYPE_COLUMNS}
    require_columns(phenotypes, ["protein_id", "phenotype_type", "phenotype_raw", "phenotype_evidence_level", *EVIDENCE_COLUMNS, *given.values()], "phenotypes")
    substrate = F.when(F.col("phenotype_type") == "substrate_specificity", F.col("phenotype_raw"))
    ids = [F.collect_set(F.when(F.col(c) != "", F.col(c))) for c in EVIDENCE_COLUMNS]
    references = F.sort_array(F.array_union(*ids))
    return phenotypes.groupBy("protein_id").agg(
        *[distinct_text(F.col(source)).alias(name) for name, source in given.items()],
        distinct_text(substrate, blanks=True).alias("substrate_specificity_text"),
        distinct_text(F.col("phenotype_evidence_level"), blanks=True).alias("phenotype_evidence_level"),
        F.when(F.size(references) > 0, F.array_join(references, "|")).alias("phenotype_references"),
    )


def master_view(proteins: DataFrame, assignments: DataFrame, evidence: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """All columns of the master table, in order: proteins with their families, evidence and phenotypes.

    A protein without a family has one row with NULL family columns, one with two families two rows. Children are folded
    per protein before they are joined, so no join multiplies rows. A table that lacks a column raises an error.
    """
    require_columns(proteins, PROTEIN_COLUMNS, "proteins")
    named = {c: ASSIGNMENT_NAMES.get(c, c) for c in ASSIGNMENT_COLUMNS}
    require_columns(assignments, ["protein_id", *named.values()], "assignments")
    families = assignments.select("protein_id", *[F.col(source).alias(name) for name, source in named.items()])
    joined = proteins.select(*PROTEIN_COLUMNS).join(families, "protein_id", "left")
    joined = joined.join(evidence_texts(evidence), "protein_id", "left").join(phenotype_texts(phenotypes), "protein_id", "left")
    return joined.select(*MASTER_COLUMNS)


def master_export(view: DataFrame, columns: Sequence[str] = MASTER_COLUMNS, token_columns: Sequence[str] = MASTER_TOKEN_COLUMNS) -> DataFrame:
    """Fixed column order with repeated and blank tokens removed; a view that lacks a column raises an error."""
    require_columns(view, columns, "the master view")
    return view.select(*[(dedupe_tokens(F.col(c)) if c in token_columns else F.col(c)).alias(c) for c in columns])
