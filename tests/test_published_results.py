"""Published result rows that a formula must reproduce from their own columns."""

import pytest
from pyspark.sql import functions as F

from pelagia.functions.tails import chi2_tail_1df
from pelagia.operators import richness, stats

# Genomes, observed clusters, estimate, interval, share observed, once seen, twice seen.
CHAO2 = [
    (38744, 1003, 1418, 1313, 1559, 70.7, 326, 128),
    (38744, 2314, 3563, 3353, 3816, 64.9, 857, 294),
    (38744, 4345, 6762, 6472, 7092, 64.3, 1752, 635),
    (38744, 10102, 18958, 18303, 19664, 53.3, 5204, 1529),
]

# Statistic, its tail probability and the corrected value of fifteen tests.
TESTS = [
    (380.92, 7.84e-85, 1.96e-84), (528.59, 5.73e-117, 2.15e-116), (351.15, 2.38e-78, 5.1e-78), (140.86, 1.73e-32, 2.88e-32),
    (229.17, 9.02e-52, 1.69e-51), (79.43, 5e-19, 6.25e-19), (642.38, 1.02e-141, 5.1e-141), (2023.33, 0.0, 0.0),
    (470.23, 2.86e-104, 8.58e-104), (86.06, 1.75e-20, 2.39e-20), (6.22, 0.0127, 0.0127), (3865.15, 0.0, 0.0),
    (22.22, 2.44e-06, 2.82e-06), (7.59, 0.00588, 0.0063), (92.40, 7.07e-22, 1.06e-21),
]

# Bucket, least and greatest size, clusters, share, memberships, share.
OCCUPANCY = [
    ("1", 1, 1, 1752, 40.32, 1752, 2.86), ("2-5", 2, 5, 1354, 31.16, 4006, 6.54), ("6-20", 6, 20, 746, 17.17, 8016, 13.09),
    ("21-100", 21, 100, 387, 8.91, 16452, 26.87), (">100", 101, 10**6, 106, 2.44, 30993, 50.63),
]


def test_chao2(frame):
    rows = frame([(r[0], r[1], r[6], r[7]) for r in CHAO2], "n_units long, observed long, q1 long, q2 long")
    out = richness.chao2_from_counts(rows).orderBy("observed").collect()
    for got, want in zip(out, CHAO2):
        assert [round(got[c]) for c in ("estimate", "ci_low", "ci_high")] == list(want[2:5])
        assert round(got["pct_observed"], 1) == want[5]


def test_corrected_p_values(frame):
    rows = frame([(i, t[1]) for i, t in enumerate(TESTS)], "i int, p double")
    for r in stats.benjamini_hochberg(rows, "p").collect():
        assert r["q_value"] == pytest.approx(TESTS[r["i"]][2], rel=6e-3)


def test_tail_probability(frame):
    rows = frame([(t[0], t[1]) for t in TESTS], "x double, p double")
    for r in rows.withColumn("got", chi2_tail_1df("x")).collect():
        # Statistics are printed with two decimals, which moves the tail by up to half a per cent.
        assert r["got"] == pytest.approx(r["p"], rel=6e-3, abs=1e-300)


def test_occupancy(spark):
    sizes = []
    for _, low, high, n, _, total, _ in OCCUPANCY:
        spare = total - n * low
        for _ in range(n):
            extra = min(spare, high - low)
            sizes.append((low + extra,))
            spare -= extra
    out = {r["bucket"]: r for r in richness.occupancy_spectrum(spark.createDataFrame(sizes, "n_genomes long")).collect()}
    for bucket, _, _, n, share, total, member_share in OCCUPANCY:
        got = out[bucket]
        assert (got["n_clusters"], got["n_memberships"]) == (n, total)
        assert (round(got["pct_of_clusters"], 2), round(got["pct_of_occupancy"], 2)) == (share, member_share)
    assert spark.createDataFrame(sizes, "n_genomes long").agg(F.count("n_genomes")).first()[0] == 4345
