"""The master table: all columns, child texts, missing columns and export."""

import pytest

from pelagia.operators import master
from pelagia.sources.schemas import MASTER_COLUMNS


def frames(spark):
    def table(columns, rows):
        return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], ", ".join(f"{c} string" for c in columns))

    proteins = table(master.PROTEIN_COLUMNS, [{"protein_id": "P1", "gene_name": "phaC", "ec_numbers": "1|2||1", "sequence": "MKV"}, {"protein_id": "P2"}])
    families = ["protein_id", "family_id", "pha_subfamily", "retrieval_reasons", "evidence_tier", "cluster95_id", "cluster95_representative", "cluster95_size"]
    assignments = table(families, [{"protein_id": "P1", "family_id": f, "retrieval_reasons": "a|a|b"} for f in ("phaR_synthase", "phaR_regulator")])
    evidence = table(["protein_id", *master.EVIDENCE_COLUMNS], [
        {"protein_id": "P1", "literature_pmids": p, "literature_dois": ""} for p in ("7|8", "7|8", "9|7", "", None)])
    given = [master.PHENOTYPE_NAMES.get(c, c) for c in master.PHENOTYPE_COLUMNS]
    columns = ["protein_id", "phenotype_type", "phenotype_raw", "phenotype_evidence_level", *master.EVIDENCE_COLUMNS, *given]
    phenotypes = table(columns, [
        {"protein_id": "P1", "phenotype_type": "substrate_specificity", "phenotype_raw": "accumulates PHB", "demonstrated_polymers": "PHB", "phenotype_evidence_level": "x", "literature_dois": "d1", "ph_optimum": "7"},
        {"protein_id": "P1", "phenotype_type": "substrate_specificity", "phenotype_raw": "also PHBV", "demonstrated_polymers": "PHBV", "phenotype_evidence_level": "", "literature_pmids": "9", "ph_optimum": "7"},
        {"protein_id": "P1", "phenotype_type": "other", "phenotype_raw": "no", "temperature_optimum": "30", "composition_text": ""},
    ])
    return proteins, assignments, evidence, phenotypes


def test_view_has_every_column_and_folds_children(spark):
    view = master.master_view(*frames(spark))
    assert view.columns == MASTER_COLUMNS
    rows = {(r.protein_id, r.pha_family): r for r in view.collect()}
    assert set(rows) == {("P1", "phaR_synthase"), ("P1", "phaR_regulator"), ("P2", None)}
    r = rows["P1", "phaR_synthase"]
    assert r.demonstrated_polymers == "PHB|PHBV" and r.literature_pmids == "7|8|9|7" and r.literature_dois is None
    assert r.substrate_specificity_text == "accumulates PHB|also PHBV" and r.phenotype_evidence_level == "|x"
    assert r.phenotype_references == "9|d1" and r.temperature_optimum == "30" and r.ph_optimum == "7" and r.polymer_composition_text is None
    assert all(rows["P2", None][c] is None for c in MASTER_COLUMNS[1:])


def test_export_removes_repeated_tokens(spark):
    out = {r.protein_id: r for r in master.master_export(master.master_view(*frames(spark))).collect()}
    assert (out["P1"].ec_numbers, out["P1"].retrieval_reason, out["P1"].literature_pmids, out["P1"].phenotype_evidence_level) == ("1|2", "a|b", "7|8|9", "x")
    assert out["P2"].ec_numbers is None


@pytest.mark.parametrize("which, column", [(0, "reviewed"), (1, "cluster95_size"), (2, "literature_dois"), (3, "specific_activity")])
def test_missing_columns_are_an_error(spark, which, column):
    tables = list(frames(spark))
    tables[which] = tables[which].drop(column)
    with pytest.raises(ValueError, match=column):
        master.master_view(*tables)
    with pytest.raises(ValueError, match="ph_range"):
        master.master_export(master.master_view(*frames(spark)).drop("ph_range"))
