import math
import pytest
from pyspark.sql import functions as F

from pelagia.functions import evidence, geo, text


@pytest.mark.parametrize(
    "raw, metres",
    [
        ("0 m", 0.0), ("200", 200.0), ("Surface water", 0.0), ("10-20 m", 15.0), ("10 to 20 m", 15.0), ("-2 m", -2.0),
        ("not collected", None), ("5 cm", 5.0), ("5cm", None), ("", None), (None, None),
    ],
)
def test_depth_text(spark, frame, raw, metres):
    out = frame([(raw,)], "raw string").select(text.depth_in_metres(F.col("raw"))).first()[0]
    assert out == metres


@pytest.mark.parametrize(
    "metres, zone",
    [(-2.0, "0-50m"), (49.9, "0-50m"), (50.0, "50-200m"), (199.9, "50-200m"), (200.0, "200-1000m"), (999.9, "200-1000m"),
     (1000.0, "1000-4000m"), (3999.9, "1000-4000m"), (4000.0, ">4000m"), (None, "")],
)
def test_depth_zone(frame, metres, zone):
    assert frame([(metres,)], "m double").select(geo.depth_zone(F.col("m"))).first()[0] == zone


def test_short_codes_and_label(frame):
    assert [text.short_code(f) for f in ("phaA", "phaR_regulator", "phaR_synthase")] == ["A", "RReg", "RSyn"]
    order = ["phaA", "phaR_regulator", "phaR_synthase"]
    row = frame([(1, 0, 2)], "a int, b int, c int")
    label = text.architecture_label({"phaA": F.col("a"), "phaR_regulator": F.col("b"), "phaR_synthase": F.col("c")}, order)
    assert row.select(label).first()[0] == "ARSyn"
    assert row.select(text.label_codes(F.lit("ARSyn"), order)).first()[0] == ["A", "RSyn"]
    with pytest.raises(Exception, match="unknown codes"):
        row.select(text.label_codes(F.lit("AQ"), order)).collect()


def test_tokens(frame):
    row = frame([("a|b||a", None, "")], "v string, n string, e string")
    out = row.select(
        text.dedupe_tokens(F.col("v")), text.dedupe_tokens(F.col("n")), text.dedupe_tokens(F.col("e")),
        text.union_tokens(F.col("v"), F.array(F.lit("c"), F.lit("a"))), text.union_tokens(F.col("n"), F.array().cast("array<string>")),
    ).first()
    assert tuple(out) == ("a|b", None, "", "a|b|c", None)


def test_genome_of_member(frame):
    row = frame([("G1-scaffold_2_7", "odd")], "m string, o string")
    out = row.select(
        text.genome_of_member(F.col("m")), text.genome_of_member(F.col("o")), text.genome_of_member(F.col("o"), "blank"),
        text.genome_of_member(F.col("o"), "whole"), text.scaffold_of_gene(F.col("m")), text.gene_number(F.col("m")),
    ).first()
    assert tuple(out) == ("G1", None, "", "odd", "G1-scaffold_2", 7)
    with pytest.raises(Exception, match="genome part"):
        row.select(text.genome_of_member(F.col("o"), "error")).collect()


VOCAB = {"3HB": ["3-hydroxybutyrate", "3HB"], "PHBV": ["poly(3-hydroxybutyrate-co-valerate)", "PHBV"], "PHB": ["PHB"]}


def test_vocabulary_whole_phrase_longest_first(frame):
    row = frame([("PHBV and 3HB", "xPHBx")], "t string, u string")
    out = row.select(text.vocabulary_codes(F.col("t"), VOCAB), text.vocabulary_codes(F.col("u"), VOCAB)).first()
    assert out[0] == ["PHBV", "3HB"] and out[1] == []


def test_phenotype_levels_never_upgrade(frame):
    rows = frame([("makes 3HB", evidence.EXPERIMENTAL), ("makes 3HB", evidence.GENERIC)], "t string, l string")
    out = [r[0] for r in rows.select(evidence.normalized_phenotype(F.col("t"), F.col("l"), VOCAB, {})).collect()]
    assert out[0]["demonstrated_monomers"] == "3HB" and out[1]["demonstrated_monomers"] is None
    assert out[1]["phenotype_raw"] == "makes 3HB"


def test_clean_sequence_and_motif(frame):
    row = frame([("acBdeXX", "GACAGGACAG")], "s string, m string")
    c = row.select(text.clean_sequence(F.col("s"))).first()[0]
    assert (c["clean"], c["raw_length"], c["clean_length"], c["n_terminal_x"], c["n_noncanonical"]) == ("ACXDE", 7, 5, 2, 1)
    assert row.select(text.motif_positions(F.col("m"), "G.C.G", 5, 2)).first()[0] == [3, 8]
    assert row.select(text.kmers(F.lit("ABCD"), 3)).first()[0] == ["ABC", "BCD"]
    assert row.select(text.kmers(F.lit("AB"), 3)).first()[0] == []


def test_haversine_and_basin(frame):
    row = frame([(0.0, 0.0, 0.0, 180.0)], "a double, b double, c double, d double")
    km = row.select(geo.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0]
    assert abs(km - 3.141592653589793 * geo.EARTH_RADIUS_KM) < 1e-6
    assert row.select(geo.ocean_basin(F.lit(10.0), F.lit(70.0))).first()[0] == "Indian Ocean"
    assert row.select(geo.wrap_longitude(F.lit(190.0))).first()[0] == -170.0


def test_log_factorial_series():
    import numpy as np

    from pelagia.functions.tails import log_factorial

    n = np.array([0, 1, 2, 5, 10, 100, 12345, 10**7, 10**12], dtype=float)
    assert np.allclose(log_factorial(n), [math.lgamma(v + 1) for v in n], rtol=1e-14, atol=1e-12)


def test_hybrid36_keeps_the_width(frame):
    numbers = [0, 7, -999, 9999, 10000, 10035, 90001, 1223055, 1223056, 2436111]
    df = frame([(n,) for n in numbers], "n long").withColumn("w", text.to_hybrid36(F.col("n"), 4))
    rows = df.select("n", "w", text.from_hybrid36(F.col("w"), 4).alias("back")).collect()
    assert [r["w"] for r in rows[:8]] == ["0", "7", "-999", "9999", "A000", "A00Z", "BPQ9", "ZZZZ"]
    assert [r["w"] for r in rows[8:]] == ["a000", "zzzz"] and all(r["back"] == r["n"] for r in rows)
    with pytest.raises(Exception, match="does not fit"):
        frame([(2436112,)], "n long").select(text.to_hybrid36(F.col("n"), 4)).collect()
    assert [r[0] for r in frame([("A00",), ("A-00",), ("",)], "w string").select(text.from_hybrid36(F.col("w"), 4)).collect()] == [None] * 3
