import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.functions import text
from pelagia.functions.tails import fisher_two_sided
from pelagia.operators import (
    audit, community, ecology, enrich, farthest, graph, greedy_clusters, hits, matrix, neighborhood, reference, richness, sequences, spatial, stats,
)

ECO = "target_id string, genome string, lat double, lon double, depth_m double, genus string, phylum string, study string, ord int"


def eco_rows(frame):
    rows = frame(
        [("T1", "G1", 10.0, 20.0, 10.0, "Moritella", "P", "S1", 1), ("T2", "G2", 10.1, 20.1, 30.0, "Moritella", "P", "S1", 2),
         ("T3", "G1", 10.0, 20.0, 10.0, "Moritella", "P", "S1", 3), ("T4", "G3", -40.0, 100.0, None, "", "P", "S2", 4)], ECO)
    clusters = frame([("T1", "REP1"), ("T2", "REP1"), ("T3", "REP1"), ("T4", "REP2")], "member string, rep string")
    return ecology.with_clusters(rows, clusters)


def test_cluster_ecology(frame):
    out = {r["cluster_id"]: r for r in ecology.cluster_ecology(eco_rows(frame)).collect()}
    a, b = out["REP1"], out["REP2"]
    assert (a["n_target_ids"], a["n_genomes"], a["median_depth_m"], a["top_genera"]) == (3, 2, 20.0, "Moritella (2)")
    assert (b["median_depth_m"], b["n_genomes_with_depth"]) == (None, 0)


def test_dispersion_limits(frame):
    same = frame([("c", f"g{i}", 12.0, 34.0) for i in range(5)], "cluster_id string, genome string, lat double, lon double")
    opposite = frame([("c", "a", 0.0, 0.0), ("c", "b", 0.0, 180.0)], "cluster_id string, genome string, lat double, lon double")
    assert ecology.spherical_dispersion(same).first()["resultant_length"] == pytest.approx(1.0)
    assert farthest.farthest_km(same).first()["max_pairwise_km"] == pytest.approx(0.0)
    assert ecology.spherical_dispersion(opposite).first()["resultant_length"] < 0.01


@pytest.mark.parametrize("n, kept", [(7, 7), (10, 10), (37, 10)])
def test_strided_sample_keeps_even_positions(frame, n, kept):
    points = frame([("c", f"g{i}", float(i), 0.0) for i in range(n)], "cluster_id string, genome string, lat double, lon double")
    assert ecology.strided_sample(points, cap=10).count() == kept


def test_clade_depth(frame):
    rows = frame(
        [("T1", "G1", "Qd", 2000.0), ("T2", "G1", "Qd", 2000.0), ("T3", "G2", "Qd", 2000.0), ("T4", "G3", "Qs", 5.0),
         ("T5", "G4", "Qs", 6.0), ("T6", "G5", "Qs", None)], "target_id string, genome string, best_query string, depth_m double")
    counts = matrix.clade_depth_counts(rows, "best_query")
    cell = {(r["clade"], r["zone"]): (r["n_genomes"], r["n_targets"]) for r in counts.collect()}
    assert cell[("Qd", "1000-4000m")] == (2, 3) and cell[("Qs", "(unknown depth)")] == (1, 1)
    assert [r["clade"] for r in matrix.clade_depth_wide(counts).collect()][0] == "Qs"


def test_genome_matrix_and_summary(frame):
    rows = frame([("T1", "phaA", "Q", "G1", 1), ("T2", "phaA", "Q", "G1", 2), ("T3", "phaA", "Q", "G2", 3), ("T4", "phaB", "Q", "G1", 4),
                  ("T5", "phaB", "BAD", "G2", 5)], "target_id string, family string, best_query string, genome string, ord int")
    rows = rows.withColumn("genus", F.lit("g")).withColumn("species", F.lit("s")).withColumn("study", F.lit("st"))
    kept = matrix.drop_bad_queries(rows, frame([("phaB", "BAD")], "family string, best_query string"))
    out = matrix.genome_family_matrix(kept, ["phaA", "phaB"], ["genus", "species", "study"])
    assert {r["genome"]: (r["n_phaA"], r["n_phaB"], r["architecture"]) for r in out.collect()} == {"G1": (2, 1, "AB"), "G2": (1, 0, "A")}
    assert [r["pct_of_genomes"] for r in matrix.architecture_summary(out, ["phaA", "phaB"]).collect()] == [50.0, 50.0]


def test_qualifying_is_strict(frame):
    rows = frame([("a", 0, 6), ("b", 2, 8), ("c", 0, 5)], "genome string, n_phaC int, n_families_present int")
    assert [r["genome"] for r in audit.qualifying_genomes(rows).collect()] == ["a"]


def test_anchor_family_is_refused(frame):
    rows = frame([("a", "T")], "genome string, target_id string")
    with pytest.raises(ValueError):
        enrich.anchor_rows(rows, {"phaC": rows})


def test_membership_cap_and_true_count(frame):
    rows = frame([("T1", 2, "G1-scaffold_1_1;G1-scaffold_2_2"), ("T2", 3, "G3-scaffold_1_1;G1-scaffold_1_1;G2-scaffold_1_1"), ("T3", 1, "G9-scaffold_1_1")],
                 "target_id string, size int, members string")
    wanted = frame([("T1",), ("T2",)], "target_id string")
    out = {r["target_id"]: r for r in enrich.capped_target_genomes(rows, wanted, 2).collect()}
    assert set(out) == {"T1", "T2"} and out["T1"]["n_genomes_total"] == 1
    assert (out["T2"]["genomes"], out["T2"]["n_genomes_total"]) == (["G1", "G2"], 3)


def test_anchor_match_and_windows(frame, rows_of):
    genes = frame([("g", "a", "MKT*"), ("g", "b", "MKTX"), ("g", "c", "MLT"), ("h", "d", "MKT")], "genome string, gene_id string, sequence string")
    anchors = frame([("g", "MKT")], "genome string, sequence string")
    assert rows_of(neighborhood.match_anchors(genes, anchors), "gene_id") == [("a",), ("b",)]
    line = frame([("s", i, i in (13,)) for i in range(1, 26)] + [("t", i, i in (5, 8)) for i in range(1, 21)], "scaffold string, pos long, anchor boolean")
    out = neighborhood.neighbourhood_windows(line, F.col("anchor"), "scaffold", 3)
    assert [r["pos"] for r in out.where("scaffold = 's'").orderBy("pos").collect()] == list(range(10, 17))
    out = neighborhood.neighbourhood_windows(line, F.col("anchor"), "scaffold", 2)
    assert [r["pos"] for r in out.where("scaffold = 't'").orderBy("pos").collect()] == list(range(3, 11))


def test_best_hit_batches_and_cap(spark, frame):
    rows = [("q1", "t", 1e-5, 50.0, 90.0, 0.9, 0.9), ("q2", "t", 1e-5, 60.0, 80.0, 0.8, 0.7), ("q1", "u", 1e-9, 10.0, 70.0, 0.5, 0.4)]
    df = frame(rows, "query string, target string, evalue double, bits double, pident double, qcov double, tcov double")
    best = {r["target_id"]: (r["best_query"], r["n_queries_matching"]) for r in hits.best_hit_per_target(df).collect()}
    assert best == {"t": ("q2", 2), "u": ("q1", 1)}
    tagged = df.withColumn("batch", F.when(F.col("query") == "q1", 0).otherwise(1))
    assert hits.concat_batches(tagged, 2).count() == 3
    with pytest.raises(ValueError):
        hits.concat_batches(tagged, 3)
    with pytest.raises(ValueError):
        hits.batch_of(df, "query", 2, 2, F.lit(0))
    assert hits.queries_at_cap(df, 2).first()["query"] == "q1"


def test_upsert_assignment_rules(frame):
    rows = frame(
        [("p", "f", "r1", "CANDIDATE_AMBIGUOUS", True, None, None, 1), ("p", "f", "r2", "GOLD_EXPERIMENTAL", False, "I", "n", 2),
         ("p", "f", "r1", "CANDIDATE_AMBIGUOUS", True, "II", None, 3), ("q", "f", "r1", "CANDIDATE_AMBIGUOUS", True, None, None, 4)],
        "protein_id string, family string, reason string, tier string, needs_manual_review boolean, subfamily string, confidence_notes string, ord int")
    whole = {r["protein_id"]: r for r in reference.upsert_assignments(None, rows).collect()}
    assert (whole["p"]["reason"], whole["p"]["tier"], whole["p"]["needs_manual_review"], whole["p"]["subfamily"]) == ("r1|r2", "GOLD_EXPERIMENTAL", False, "I")
    assert whole["q"]["needs_manual_review"] is True
    first = reference.upsert_assignments(None, rows.where("ord <= 2"))
    again = {r["protein_id"]: r for r in reference.upsert_assignments(first, rows.where("ord > 2")).collect()}
    assert {k: (v["reason"], v["tier"], v["needs_manual_review"]) for k, v in again.items()} == {
        k: (v["reason"], v["tier"], v["needs_manual_review"]) for k, v in whole.items()}


def test_canonical_prefers_tier_then_id(frame):
    rows = frame([("b", "f", "h", "CURATED_REVIEWED"), ("a", "f", "h", "ANNOTATED_UNREVIEWED"), ("c", "f", "h", "CURATED_REVIEWED")],
                 "protein_id string, family string, sequence_sha256 string, tier string")
    assert reference.canonical_per_hash(rows).first()["canonical_id"] == "b"


def test_mantel_haenszel_against_loops(frame):
    rng = random.Random(2)
    tables = [("g", f"s{i}", *[rng.randint(0, 30) for _ in range(4)]) for i in range(12)] + [("g", "one", 1, 0, 0, 0), ("g", "empty", 0, 0, 5, 5)]
    out = stats.mantel_haenszel(frame(tables, "g string, s string, a long, b long, c long, d long"), ["g"]).first()
    used = [(a, b, c, d, a + b + c + d) for _, _, a, b, c, d in tables if a + b + c + d > 1 and a + b and c + d]
    r, s = sum(a * d / n for a, b, c, d, n in used), sum(b * c / n for a, b, c, d, n in used)
    e = sum((a + b) * (a + c) / n for a, b, c, d, n in used)
    v = sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1)) for a, b, c, d, n in used)
    chi = (sum(u[0] for u in used) - e) ** 2 / v
    assert out["odds_ratio"] == pytest.approx(r / s) and out["cmh_chi2"] == pytest.approx(chi)
    assert out["cmh_p"] == pytest.approx(math.erfc(math.sqrt(chi / 2))) and out["n_strata_used"] == len(used)
    assert out["ci_low"] < out["odds_ratio"] < out["ci_high"]


def test_fisher_against_enumeration():
    def brute(a, b, c, d):
        row, col, n = a + b, a + c, a + b + c + d
        p = lambda k: math.comb(row, k) * math.comb(n - row, col - k) / math.comb(n, col)
        return sum(p(k) for k in range(max(0, row + col - n), min(row, col) + 1) if p(k) <= p(a) * (1 + 1e-7))

    for t in [(3, 1, 1, 3), (8, 2, 1, 5), (0, 5, 5, 0), (20, 30, 25, 10), (2, 0, 0, 0)]:
        assert fisher_two_sided(*t) == pytest.approx(brute(*t))
    assert 0 <= fisher_two_sided(10**7, 10**7 + 500, 10**7, 10**7) <= 1


def test_benjamini_hochberg(frame):
    rows = frame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.04), ("e", None)], "k string, p double")
    q = {r["k"]: r["q_value"] for r in stats.benjamini_hochberg(rows, "p").collect()}
    assert q["a"] == pytest.approx(0.05) and q["b"] == q["d"] == pytest.approx(0.05) and q["c"] == pytest.approx(0.05) and q["e"] == 1.0


def test_chao2_branches(frame):
    rows = frame([(1000, 120, 40, 300), (50, 5, 0, 20), (10, 0, 0, 9)], "observed long, q1 long, q2 long, n_units long")
    out = richness.chao2_from_counts(rows).orderBy(F.desc("observed")).collect()
    assert out[0]["estimate"] == pytest.approx(1000 + 299 / 300 * 120**2 / 80)
    assert out[1]["estimate"] == pytest.approx(50 + 19 / 20 * 5 * 4 / 2)
    assert out[2]["ci_low"] == out[2]["estimate"] == out[2]["ci_high"] == 10
    assert all(r["ci_low"] <= r["estimate"] <= r["ci_high"] for r in out)


def test_accumulation_ends_at_all_clusters_and_follows_the_mean(spark):
    rng = random.Random(4)
    pairs = spark.createDataFrame(list({(f"c{int(rng.expovariate(0.1))}", f"g{rng.randint(1, 60)}") for _ in range(400)}), "cluster_id string, genome string")
    curve = {r["x"]: r for r in richness.accumulation_curve(pairs, 60, 1, grid=10).collect()}
    n, total = pairs.select("genome").distinct().count(), pairs.select("cluster_id").distinct().count()
    assert curve[n]["mean"] == total
    expected = {r["x"]: r["expected"] for r in richness.expected_accumulation(pairs, sorted(curve)).collect()}
    for x, row in curve.items():
        assert row["mean"] == pytest.approx(expected[x], rel=0.08)


def test_components_and_representatives(spark, frame):
    rng = random.Random(9)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2060)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in graph.connected_components(frame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in {v for a, b in edges if a != b for v in (a, b)}}


def test_climate_rings_and_interpolation(frame):
    grid = frame([(0.5, 0.5, 0.0, 10.0), (0.5, 0.5, 100.0, 20.0), (2.5, -179.5, 0.0, 5.0), (10.5, 10.5, 0.0, None)], "cell_lat double, cell_lon double, depth double, value double")
    rows = frame([("in", 0.4, 0.4, 50.0), ("deep", 0.4, 0.4, 500.0), ("exact", 0.4, 0.4, 100.0), ("near", 2.4, 2.4, 0.0), ("wrap", 2.4, 179.9, 0.0),
                  ("far", -50.0, 50.0, 0.0), ("blank", None, 0.0, 0.0)], "genome string, lat double, lon double, depth_m double")
    out = {r["genome"]: r for r in spatial.match_climate(rows, grid).collect()}
    assert (out["in"]["climate_value"], out["in"]["depth_method"], out["in"]["match_status"]) == (15.0, "depth_interpolated", "matched_exact_1deg_cell")
    assert (out["deep"]["climate_value"], out["deep"]["depth_method"]) == (20.0, "nearest_depth_outside_available_range")
    assert out["exact"]["depth_method"] == "exact_depth" and out["near"]["match_status"] == "matched_neighbor_within_2deg"
    assert out["wrap"]["climate_value"] == 5.0 and out["wrap"]["match_status"] == "matched_neighbor_within_1deg"
    assert out["far"]["match_status"] == "no_value_within_3deg" and out["blank"]["match_status"] == "missing_lat_lon_or_depth"


def test_distance_groups_against_brute_force(frame):
    rng = random.Random(3)
    pts = [(f"p{i:03d}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(120)] + [("z1", 89.9, 0.0), ("z2", 89.9, 180.0)]
    got = {r["id"]: r["component"] for r in spatial.distance_groups(frame(pts, "id string, lat double, lon double"), "id", 900.0).collect()}

    def km(a, b):
        p1, p2 = math.radians(a[1]), math.radians(b[1])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))

    label = {p[0]: p[0] for p in pts}
    for _ in pts:
        for a in pts:
            for b in pts:
                if a[0] < b[0] and km(a, b) < 900:
                    low = min(label[a[0]], label[b[0]])
                    label[a[0]] = label[b[0]] = low
    assert {frozenset(k for k in got if got[k] == v) for v in got.values()} == {frozenset(k for k in label if label[k] == v) for v in label.values()}


def _pairs(frame, d):
    n = len(d)
    return frame([(f"s{i:02d}", f"s{j:02d}", float(d[i][j])) for i in range(n) for j in range(i + 1, n)], "site_a string, site_b string, d double")


def test_community_distances(frame):
    counts = frame([("a", "x", 1), ("a", "y", 2), ("b", "x", 1), ("b", "y", 2), ("c", "z", 5)], "site string, cluster_id string, n long")
    sites = counts.select("site").distinct()
    out = {(r["site_a"], r["site_b"]): (r["bray_curtis"], r["jaccard"]) for r in community.complete_pairs(community.community_distances(counts), sites).collect()}
    assert out == {("a", "b"): (0.0, 0.0), ("a", "c"): (1.0, 1.0), ("b", "c"): (1.0, 1.0)}


def test_principal_coordinates_recover_a_rectangle(frame):
    xy = [(0, 0), (3, 0), (0, 4), (3, 4)]
    d = [[math.dist(a, b) for b in xy] for a in xy]
    out = {r["site"]: r for r in community.principal_coordinates(_pairs(frame, d), "d").collect()}
    got = [(out[f"s{i:02d}"]["axis1"], out[f"s{i:02d}"]["axis2"]) for i in range(4)]
    assert np.allclose([[math.dist(a, b) for b in got] for a in got], d, atol=1e-6)
    assert out["s00"]["share1"] + out["s00"]["share2"] == pytest.approx(1.0)


def test_mantel(frame):
    rng = np.random.default_rng(0)
    a = rng.random((14, 14))
    a = (a + a.T) / 2
    noisy = a + rng.random((14, 14)) * 0.01
    pairs = _pairs(frame, a).withColumnRenamed("d", "x").join(_pairs(frame, noisy).withColumnRenamed("d", "y"), ["site_a", "site_b"])
    sites = frame([(f"s{i:02d}",) for i in range(14)], "site string")
    out = community.mantel_test(pairs, sites, "x", "y", n_perm=49, seed=1).first()
    assert out["r"] > 0.9 and 0 < out["p_value"] < 0.05


def test_kmer_clusters_group_copies(frame):
    rng = random.Random(6)
    base = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(200)) for _ in range(4)]
    rows = []
    for i, s in enumerate(base):
        rows += [(f"m{i}_{j}", s) for j in range(3)] + [(f"m{i}_x", s[:-2] + "AA")]
    out = {r["member"]: r["rep"] for r in greedy_clusters.cluster_by_kmers(frame(rows, "id string, sequence string"), "id").collect()}
    assert len(out) == len(rows) and len(set(out.values())) == 4
    assert all(out[m].split("_")[0] == m.split("_")[0] for m in out)


def test_kmer_search_is_exact(frame):
    rng = random.Random(8)
    seqs = ["".join(rng.choice("ACDE") for _ in range(60)) for _ in range(30)]
    queries = [(f"q{i}", seqs[i][:40]) for i in range(6)]
    targets = [(f"t{i}", s) for i, s in enumerate(seqs)]
    k = lambda s: {s[i:i + 4] for i in range(len(s) - 3)}
    want = {(q, t) for q, s in queries for t, u in targets if len(k(s) & k(u)) / len(k(s)) >= 0.3}
    out = sequences.kmer_search(frame(queries, "query string, sequence string"), frame(targets, "target string, sequence string"), k=4, min_containment=0.3)
    assert {(r["query"], r["target"]) for r in out.collect()} == want


def test_composition_normalized(frame):
    out = sequences.kmer_composition(frame([("a", "ACAX"), ("b", "")], "id string, sequence string"), "id", 1).collect()
    assert {(r["id"], r["kmer"]): r["share"] for r in out} == {("a", "A"): 2 / 3, ("a", "C"): 1 / 3}


def test_triad_fallback(frame):
    atoms = [("s", 1, "C", "SG", 0.0, 0.0, 0.0), ("s", 2, "H", "NE2", 3.0, 0.0, 0.0), ("s", 3, "D", "OD1", 6.0, 0.0, 0.0), ("s", 9, "D", "CA", 50.0, 0.0, 0.0),
             ("u", 1, "C", "SG", 90.0, 0.0, 0.0), ("u", 2, "H", "NE2", 3.0, 0.0, 0.0), ("u", 3, "D", "OD1", 6.0, 0.0, 0.0), ("u", 4, "S", "OG", 0.0, 0.0, 0.0)]
    df = frame(atoms, "structure string, position int, residue string, atom string, x double, y double, z double")
    out = {r["structure"]: (r["kind"], r["nucleophile"], r["asp"], r["tight"]) for r in sequences.triad_with_fallback(df).collect()}
    assert out == {"s": ("C", 1, 3, True), "u": ("S/T", 4, 3, True)}


def test_triad_needs_both_acting_atoms_or_takes_ca(frame):
    atoms = [("a", 1, "C", "CA", 10.0, 0.0, 0.0), ("a", 2, "H", "NE2", 13.0, 0.0, 0.0), ("a", 2, "H", "CA", 20.0, 0.0, 0.0),
             ("a", 3, "D", "OD1", 16.0, 0.0, 0.0), ("a", 3, "D", "CA", 40.0, 0.0, 0.0),
             ("b", 1, "S", "OG", 60.0, 0.0, 0.0), ("b", 2, "H", "NE2", 0.0, 0.0, 0.0), ("b", 3, "D", "OD1", 30.0, 0.0, 0.0)]
    df = frame(atoms, "structure string, position int, residue string, atom string, x double, y double, z double")
    out = sequences.triad_with_fallback(df).collect()
    assert [(r["structure"], r["kind"], r["nuc_his"], r["his_asp"], r["nuc_asp"], r["in_order"], r["tight"]) for r in out] == [("a", "C", 10.0, 3.0, 30.0, False, False)]


def test_triads_against_loops_and_many_matches(frame):
    rng = random.Random(11)
    names = {"C": "SG", "S": "OG", "T": "OG1", "H": "NE2", "D": "OD1"}
    atoms = []
    for s in ("p", "q", "r"):
        for i in range(60):
            residue = rng.choice("CSTHDA")
            for atom in (names.get(residue, "CB"), "CA"):
                if rng.random() < 0.7:
                    atoms.append((s, i, residue, atom, *[float(rng.randint(0, 12)) for _ in range(3)]))
    held = {}
    for s, i, r, a, *xyz in atoms:
        held.setdefault((s, i, r), {}).setdefault("act" if a == names.get(r) else a, []).append(xyz)

    def gap(s, a, b):
        x, y = held[(s, *a)], held[(s, *b)]
        kind = "act" if "act" in x and "act" in y else "CA"
        return min((math.sqrt(sum((u - v) ** 2 for u, v in zip(p, q))) for p in x.get(kind, []) for q in y.get(kind, [])), default=None)

    want = {}
    for s in ("p", "q", "r"):
        at = lambda letters: [(i, r) for t, i, r in held if t == s and r in letters]
        near = lambda h, others: min(((g, o[0], o) for o in others if (g := gap(s, o, h)) is not None), default=None)
        both = [(n[0] + d[0], h[0], n, d) for h in at("H") if (n := near(h, at("C"))) and (d := near(h, at("D")))]
        if both:
            score, his, n, d = min(both)
            want[s] = (n[1], his, d[1], score, gap(s, n[2], d[2]))
    df = frame(atoms, "structure string, position int, residue string, atom string, x double, y double, z double")
    got = {r["structure"]: (r["nucleophile"], r["his"], r["asp"], r["score"], r["nuc_asp"]) for r in sequences.structural_triads(df).collect()}
    assert got == want and len(want) == 3
    # A long chain of matches takes time in proportion to its length (200,000 matches never ended as a growing list).
    long = frame([("p", "GACAG" * 200_000)], "structure string, sequence string")
    positions = text.motif_positions(F.col("sequence"), "G.C.G", 5, 2)
    assert tuple(long.select(F.size(positions), positions[199_999]).first()) == (200_000, 999_998)
    short = frame([("GACAGACAG", i) for i in (1, 2, 3, 7, 8, 9, 20, None)], "m string, p int").unionByName(frame([(None, 3)], "m string, p int"))
    at = [r[0] for r in short.select(text.motif_at(F.col("m"), "G.C.G", 5, F.col("p"), 2)).collect()]
    assert at == [False, False, True, False, False, False, False, None, None]


def test_anchor_sequences_send_a_text_once(frame):
    hits_ = frame([(f"g{i % 7}", f"t{i % 5}") for i in range(200)] + [("g0", "t9"), (None, "t0")], "genome string, target string")
    texts = [("t0", "AA"), ("t1", "AA"), ("t2", "B"), ("t3", ""), ("t4", None), ("t0", "CC"), ("t8", "D")]
    df = frame(texts, "target string, sequence string")
    out = neighborhood.anchor_sequences(hits_, df)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(g, s) for g in [None, *[f"g{i}" for i in range(7)]] for s in ("AA", "B", "CC") if g or s != "B"], key=repr)
    # Pairs are told apart without their text: no grouping key of the plan after the join is the sequence.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("sequence" in line.split("],")[0] for line in plan.splitlines() if "Aggregate [genome" in line)


def test_facts_come_from_a_table_of_genomes(spark, frame):
    from pelagia.plans.common import FAMILY_ORDER, MATRIX_FACTS, family_matrix, rel

    sf = "/root/testdata/sf0.001"
    kept = matrix.drop_bad_queries(rel(spark, sf, "annotated"), rel(spark, sf, "bad_queries"))
    want = matrix.genome_family_matrix(kept, FAMILY_ORDER, MATRIX_FACTS)
    got = family_matrix(spark, sf)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "min_by" not in got._jdf.queryExecution().optimizedPlan().toString()  # no hit carries facts to an aggregate
    counts = frame([("g1", 2), ("g2", 1)], "genome string, n long")
    facts = frame([("g1", "a"), ("g1", "a"), ("g3", "b")], "genome string, genus string")
    assert [tuple(r) for r in matrix.add_facts(counts, facts, ["genus"]).collect()] == [("g1", 2, "a")]


def test_cluster_facts_come_from_a_table_of_genomes(frame):
    rows = eco_rows(frame)
    about = rows.groupBy("genome").agg(*[F.min_by(c, "ord").alias(c) for c in ("lat", "lon", "depth_m", "genus", "phylum", "study")])
    lean = rows.select("target_id", "genome", "ord", "cluster_id")
    stray = lean.unionByName(frame([("T8", "G8", 9, "REP1")], "target_id string, genome string, ord int, cluster_id string"))
    want = [tuple(r) for r in ecology.cluster_ecology(rows).collect()]
    assert [tuple(r) for r in ecology.cluster_ecology(stray, facts=about).collect()] == want


def test_variant_table_deals_rows_before_it_makes_them_distinct(frame):
    rows = [("t", f"g{i}", g) for i, g in enumerate(["a", "a", "b", None, "", "c", "c", "d", "e", "f"])] * 2 + [("u", "g1", ""), ("u", "g2", None)]
    out = audit.variant_table(frame(rows, "target_id string, genome string, genus string"))
    got = {r.target_id: (r.n_genomes, r.genera) for r in out.collect()}
    assert got == {"t": (10, "a (2); c (2); b (1); d (1); e (1)"), "u": (2, None)}
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    assert "REPARTITION_BY_COL" in [line for line in plan if "Exchange" in line][-1]
