"""Column functions that turn evidence into levels, tiers, classes and labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pelagia.functions.text import looks_like_composition, mentions_any, vocabulary_codes

# Evidence tiers, weakest first, with their rank.
TIER_RANK = {
    "CANDIDATE_AMBIGUOUS": 1,
    "ANNOTATED_UNREVIEWED": 2,
    "CURATED_REVIEWED": 3,
    "GOLD_EXPERIMENTAL": 4,
}

# Phenotype evidence levels, and the two that may name a demonstrated product.
EXPERIMENTAL = "experimental_literature"
CURATED = "curated_specific_function"
GENERIC = "generic_reaction_annotation"
INFERRED = "inferred_annotation"
DEMONSTRATED_LEVELS = [EXPERIMENTAL, CURATED]
EXPERIMENTAL_FIELDS = ["natural_substrates_products", "substrates_products", "general_information"]

# Words that show a text is about the polymer family.
CONTEXT_KEYWORDS = [
    "polyhydroxyalkanoate",
    "polyhydroxybutyrate",
    "poly-3-hydroxybutyrate",
    "poly(3-hydroxy",
    "hydroxyalkanoate",
    "hydroxybutyrate",
    "hydroxyvalerate",
    " pha ",
    "(pha)",
    " phb ",
    "(phb)",
]

# Habitats that are not part of the ocean, and habitats shown under another name.
EXCLUDED_HABITATS = [
    "NA", "", "Control", "Synthetic", "Freshwater river water", "Freshwater lake water",
    "Freshwater lake sediment", "Freshwater aquaculture water", "Freshwater pond water",
    "Glacier-fed stream water", "Aquifer water", "Polar desert soil", "Seawater microcosm",
    "Sediment microcosm", "Negative control",
]
HABITAT_LABELS = {
    "Marine Porifera tissue": "Marine sponge (Porifera) tissue",
    "Marine Hydrozoa tissue": "Marine hydrozoan tissue",
    "Marine algae thallus": "Marine algal thallus",
}

# Thermal class label to the middle of its range, in degrees Celsius.
THERMAL_MIDPOINTS = {
    "<40": 37.5, "[40-45)": 42.5, "[45-50)": 47.5, "[50-55)": 52.5, "[55-60)": 57.5,
    "[60-65)": 62.5, "[65-70)": 67.5, "[70-75)": 72.5, "[75-80)": 77.5, "80<=": 82.5,
}


def mapped(value: Column, mapping: Mapping, default: Column | None = None) -> Column:
    """CASE lookup in a small fixed mapping."""
    out = None
    for key, result in mapping.items():
        out = (F if out is None else out).when(value == key, F.lit(result))
    return out.otherwise(default) if default is not None else out


def has_context(*texts: Column) -> Column:
    return mentions_any(texts, CONTEXT_KEYWORDS)


def field_evidence_level(field: Column) -> Column:
    return F.when(field.isin(EXPERIMENTAL_FIELDS), EXPERIMENTAL).otherwise(GENERIC)


def function_evidence_level(text: Column, monomers: Mapping, polymers: Mapping) -> Column:
    """Curated only when the text itself names a monomer or polymer of the vocabularies."""
    named = (F.size(vocabulary_codes(text, monomers)) > 0) | (F.size(vocabulary_codes(text, polymers)) > 0)
    return F.when(named, CURATED).otherwise(GENERIC)


def normalized_phenotype(text: Column, level: Column, monomers: Mapping, polymers: Mapping) -> Column:
    """Struct of raw text, demonstrated codes (only on the two allowed levels) and composition text."""
    allowed = level.isin(DEMONSTRATED_LEVELS) & text.isNotNull()

    def codes(terms: Mapping) -> Column:
        found = vocabulary_codes(text, terms)
        return F.when(allowed & (F.size(found) > 0), F.array_join(found, "|"))

    return F.struct(
        text.alias("phenotype_raw"),
        codes(monomers).alias("demonstrated_monomers"),
        codes(polymers).alias("demonstrated_polymers"),
        F.when(looks_like_composition(text), text).alias("composition_text"),
        level.alias("phenotype_evidence_level"),
    )


def tier_rank(tier: Column) -> Column:
    return mapped(tier, TIER_RANK)


def better_tier(a: Column, b: Column) -> Column:
    return F.when(tier_rank(a) >= tier_rank(b), a).otherwise(b)


def tier_for_reason(reason: Column, reviewed: Column, specific: Column) -> Column:
    """Struct (tier, needs_manual_review) of a protein reached through a retrieval reason."""
    by_name = reason.endswith("_gene_name") | reason.endswith("_protein_name")
    tier = (
        F.when(specific, "GOLD_EXPERIMENTAL")
        .when(reason.endswith("_ec"), "CANDIDATE_AMBIGUOUS")
        .when(by_name & reviewed, "CURATED_REVIEWED")
        .when(by_name, "ANNOTATED_UNREVIEWED")
        .otherwise("CANDIDATE_AMBIGUOUS")
    )
    return F.struct(tier.alias("tier"), (tier == "CANDIDATE_AMBIGUOUS").alias("needs_manual_review"))


def habitat_label(habitat: Column) -> Column:
    return mapped(habitat, HABITAT_LABELS, habitat)


def hit_tier(identity: Column, query_cov: Column, target_cov: Column) -> Column:
    """A/B/C by identity when both coverages reach 0.8, D when only the target does, else E."""
    full_target = target_cov >= 0.8
    return (
        F.when((query_cov >= 0.8) & full_target & (identity >= 50), "A")
        .when((query_cov >= 0.8) & full_target & (identity >= 30), "B")
        .when((query_cov >= 0.8) & full_target, "C")
        .when(full_target, "D")
        .otherwise("E")
    )


def as_percent(score: Column) -> Column:
    """A confidence stored as a share or as a percentage, always as a percentage."""
    return F.when(score <= 1.0, score * 100).otherwise(score)


def fold_verdict(fold: Column, coverage: Column, tight: Column, same_fold: float = 0.5, complete: float = 0.75) -> Column:
    """Structure verdict; ``tight`` is three-valued and NULL means the site was not measured."""
    return (
        F.when(fold.isNull(), "no fold evidence")
        .when(fold < same_fold, "fold does not match a synthase")
        .when(F.coalesce(~tight, F.lit(False)), "synthase fold, no closed active site")
        .when(F.coalesce(coverage < complete, F.lit(False)), "synthase fold, partial coverage of reference")
        .when(tight.isNull(), "complete synthase fold (active site not measured)")
        .otherwise("complete synthase, closed active site")
    )


def aligned_triad(cys: Column, asp: Column, his: Column, before: Column, after: Column) -> Column:
    """Struct of triad flags from the residues aligned to the reference columns (``-``/``.`` are gaps)."""
    cys_ok, asp_ok, his_ok = cys == "C", asp == "D", his == "H"
    covered = ~(cys.isin("-", ".") | asp.isin("-", ".") | his.isin("-", "."))
    return F.struct(
        cys_ok.alias("cys_ok"),
        asp_ok.alias("asp_ok"),
        his_ok.alias("his_ok"),
        (cys_ok & asp_ok & his_ok).alias("triad_complete"),
        cys.isin("S", "T").alias("ser_thr_at_nucleophile"),
        ((before == "G") & cys_ok & (after == "G")).alias("lipase_box_match"),
        covered.alias("fully_covered"),
    )


def revised_audit_class(audit: Column, domains: Column, bad: Column, markers: Column) -> Column:
    """Audit class after a domain check: bad domain, promoting marker, or missing marker."""
    empty = F.array().cast("array<string>")
    domains, bad, markers = (F.coalesce(c, empty) for c in (domains, bad, markers))
    has_bad = F.arrays_overlap(domains, bad)
    has_good = F.arrays_overlap(domains, markers)
    unclear = audit.startswith("UNCLEAR") | audit.startswith("WRONG_SPECIFIC")
    no_marker = audit.startswith("ON_TARGET") & (F.size(markers) > 0) & (F.size(domains) > 0) & ~has_good
    return (
        F.when(has_bad & ~audit.startswith("WRONG"), "WRONG_GENE-domain_audit")
        .when(~has_bad & has_good & unclear, "ON_TARGET-domain_audit")
        .when(~has_bad & no_marker, "WRONG_GENE-domain_audit_no_marker")
        .otherwise(audit)
    )
