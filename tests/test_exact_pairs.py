"""Farthest pairs, greedy clusters, split self joins and resampling against plain loops."""

import functools
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.operators import audit, community, enrich, farthest, greedy_clusters, neighbours, ordering, richness, spatial, stats

PLACES = "cluster_id string, genome string, lat double, lon double"


def km(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


def test_farthest_pairs_of_many_shapes(spark, monkeypatch):
    monkeypatch.setattr(farthest, "PAIRS_PER_POINT", 1)  # so that cells are split down
    rnd = random.Random(1)
    groups = {
        "globe": [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(150)],
        "town": [(40 + rnd.uniform(0, 0.02), 5 + rnd.uniform(0, 0.02)) for _ in range(150)],
        "dateline": [(rnd.uniform(-1, 1), rnd.choice([179.5, -179.5]) + rnd.uniform(-0.4, 0.4)) for _ in range(80)],
        "poles": [(rnd.choice([-89.9, 89.9]), rnd.uniform(-180, 180)) for _ in range(60)],
        "opposite": [(10.0, 20.0), (-10.0, -160.0), (0.0, 0.0)],
        "one": [(3.0, 4.0)] * 40,
        "ring": [(0.0, float(x)) for x in range(-180, 180, 7)],
    }
    rows = [(g, f"{g}{i}", *p) for g, ps in groups.items() for i, p in enumerate(ps)]
    rows += [("none", "x", None, 3.0), ("town", "n", float("nan"), 1.0), ("town", "m", 1.0, None)]
    got = {r.cluster_id: r.max_pairwise_km for r in farthest.farthest_km(spark.createDataFrame(rows, PLACES)).collect()}
    assert set(got) == set(groups)
    for g, ps in groups.items():
        assert got[g] == pytest.approx(max(km(a, b) for a in ps for b in ps), abs=2e-3), g
    assert farthest.farthest_km(spark.createDataFrame([], PLACES)).count() == 0


def test_a_grid_of_opposite_points_is_settled_at_once(spark, monkeypatch):
    # Every point of a whole grid has its opposite, so no bound rules out any of them.
    grid = spark.range(-18, 19).selectExpr("id * 5.0D AS lat").crossJoin(spark.range(-36, 37).selectExpr("id * 5.0D AS lon"))
    half = grid.where("lat >= 0 AND lon > 0 AND lon < 175")
    decimal = spark.createDataFrame([(0.1, 0.1), (-0.1, -179.9), (7.0, 3.0), (90.0, 5.0), (89.0, 5.0)], "lat double, lon double")
    poles = spark.createDataFrame([(90.0, 5.0), (-90.0, 7.0)], "lat double, lon double")
    named = {"grid": grid, "half": half, "decimal": decimal, "poles": poles, "turned": decimal.selectExpr("-lat AS lat", "lon + 360 AS lon")}
    points = functools.reduce(lambda x, y: x.unionByName(y), [df.withColumn("cluster_id", F.lit(name)) for name, df in named.items()])
    placed = farthest.placed_points(points, "cluster_id")
    assert {r[0] for r in farthest.opposite_groups(placed, "cluster_id").collect()} == {"grid", "decimal", "poles", "turned"}
    seen = []
    monkeypatch.setattr(farthest, "candidates", lambda points, group, f=farthest.candidates: seen.append(points.count()) or f(points, group))
    got = {r.cluster_id: r.max_pairwise_km for r in farthest.farthest_km(points).collect()}
    assert seen == [half.distinct().count()]
    for name, df in named.items():
        at = [tuple(r) for r in df.collect()]
        assert got[name] == pytest.approx(max(km(a, b) for a in at for b in at[:: 1 if len(at) < 999 else 20]), abs=2e-3), name


def test_a_hot_group_is_cut_into_cells(spark):
    points = spark.range(60_000).select(
        F.lit("hot").alias("cluster_id"), F.col("id").alias("genome"), (F.pmod(F.xxhash64("id"), F.lit(1_700_001)) / 10_000 - 85).alias("lat"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(900_001)) / 10_000).alias("lon"),
    )
    placed = farthest.placed_points(points, "cluster_id")
    kept, _ = farthest.candidates(placed, "cluster_id")
    assert (kept.agg(F.sum("work")).first()[0] or 0) <= farthest.PAIRS_PER_POINT * 60_000
    got = farthest.farthest_km(points).first()["max_pairwise_km"]
    xyz = np.array([(math.cos(math.radians(r.lat)) * math.cos(math.radians(r.lon)), math.cos(math.radians(r.lat)) * math.sin(math.radians(r.lon)), math.sin(math.radians(r.lat))) for r in points.collect()])
    low = min(float((xyz[i : i + 500] @ xyz.T).min()) for i in range(0, len(xyz), 500))
    assert got == pytest.approx(6371.0088 * math.acos(low), abs=1e-2)


def brute_clusters(rows, k, share, ratio):
    first = {}
    for i, s in sorted(rows):
        first.setdefault(s or "", i)
    sets = {i: {s[j : j + k] for j in range(len(s) - k + 1)} for s, i in first.items()}
    length = {i: len(s) for s, i in first.items()}
    order = sorted((i for i in sets if sets[i]), key=lambda i: (-len(sets[i]), hashlib.md5(i.encode()).hexdigest(), i))
    like = lambda a, b: len(sets[a] & sets[b]) >= math.ceil(round(share * min(len(sets[a]), len(sets[b])), 9)) and min(length[a], length[b]) >= ratio * max(length[a], length[b])
    reps, of = [], {}
    for i in order:
        of[i] = next((r for r in reps if like(r, i)), i)
        if of[i] == i:
            reps.append(i)
    return {i: of.get(first[s or ""], first[s or ""]) for i, s in rows}


def test_greedy_clusters_against_one_by_one(spark):
    rnd = random.Random(2)
    base = ["".join(rnd.choice("ACDE") for _ in range(rnd.randint(20, 60))) for _ in range(12)]
    rows = []
    for i in range(160):
        s = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            s[rnd.randrange(len(s))] = rnd.choice("ACDE")
        rows.append((f"m{i:03d}", "".join(s[: len(s) - rnd.randint(0, 4)])))
    rows += [(f"c{i}", base[0]) for i in range(40)] + [("short", "AC"), ("short2", "AC"), ("empty", ""), ("null", None)]
    df = spark.createDataFrame(rows, "id string, sequence string")
    for share, ratio in ((0.8, 0.9), (0.5, 0.7)):
        got = {r.member: r.rep for r in greedy_clusters.cluster_by_kmers(df.repartition(5), "id", 5, share, ratio).collect()}
        assert got == brute_clusters(rows, 5, share, ratio)
    assert greedy_clusters.cluster_by_kmers(df.limit(0), "id").count() == 0


def test_bitmaps_miss_no_pair_in_any_chunk(spark, monkeypatch):
    rnd = random.Random(5)
    rows = []
    for i in range(12):
        base = "".join(rnd.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rnd.choice([20, 40, 400])))
        rows += [(f"s{i}-{j}", base[: len(base) - j]) for j in range(5)] + [(f"t{i}", base[len(base) // 10 :]), (f"u{i}", base[: len(base) // 2] * 2)]
    df = spark.createDataFrame(rows, "id string, sequence string")
    sets = {i: {s[j : j + 8] for j in range(len(s) - 7)} for i, s in rows}
    marked = greedy_clusters.marked_sets(df, 8, greedy_clusters.class_width(0.9))
    assert {r.id: r.n for r in marked.collect()} == {i: len(s) for i, s in sets.items()} and "kmers" not in marked.columns
    for chunk, few in ((2048, 4), (3, 0)):
        monkeypatch.setattr(greedy_clusters, "CHUNK", chunk)
        monkeypatch.setattr(greedy_clusters, "PAIRS_PER_ROW", few)
        got = {r.member: r.rep for r in greedy_clusters.cluster_by_kmers(df, "id").collect()}
        assert got == brute_clusters(rows, 8, 0.8, 0.9)


def test_kmers_of_one_sequence_alone_are_not_written(spark):
    df = spark.createDataFrame([("a", "ACDEFGHIKL"), ("b", "ACDEFGHIKM"), ("c", "WWYYWYWYYY")], "id string, sequence string")
    got = {r.id: (r.n, len(r.kmers), len(r.prefix)) for r in greedy_clusters.ranked_sets(df, 5, 0.8).collect()}
    assert got == {"a": (6, 5, 1), "b": (6, 5, 1), "c": (6, 0, 0)}


@pytest.mark.parametrize("block", [2048, 7])
def test_block_pairs_list_each_pair_once(spark, block):
    rnd = random.Random(3)
    rows = [("hot", f"s{i:03d}", i) for i in range(90)] + [(f"k{rnd.randint(0, 5)}", f"s{i:03d}", -i) for i in range(30)] + [(None, "s1", 1), (None, "s2", 2)]
    df = spark.createDataFrame(rows, "k string, m string, v int")
    got = sorted(tuple(r) for r in ordering.block_pairs(df, "k", "m", block).select("k", "m_a", "v_a", "m_b", "v_b").collect())
    want = sorted((a[0], a[1], a[2], b[1], b[2]) for a in rows for b in rows if a[0] is not None and a[0] == b[0] and a[1] < b[1])
    assert got == want


def test_a_hot_key_is_dealt_evenly(spark):
    df = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("m"))
    hot = 4000 // 250
    pairs = ordering.block_pairs(df, "k", "m", 250)
    assert pairs.count() == 4000 * 3999 // 2
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "_first" in plan and "_second" in plan
    sizes = [r["count"] for r in df.withColumn("b", F.pmod(F.xxhash64("m"), F.lit(hot))).groupBy("b").count().collect()]
    assert max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]


def test_mantel_from_listed_pairs_equals_all_pairs(spark):
    rnd = random.Random(4)
    names = [f"s{i:02d}" for i in range(16)]
    d = {(a, b): (rnd.random(), rnd.random()) if rnd.random() < 0.4 else (1.0, 1.0) for a in names for b in names if a < b}
    listed = spark.createDataFrame([(a, b, *v) for (a, b), v in d.items() if v[0] < 1], "site_a string, site_b string, x double, y double")
    sites = spark.createDataFrame([(n,) for n in names], "site string")
    out = community.mantel_test(listed, sites, "x", "y", n_perm=40, seed=5).first()
    pairs = sorted(d)
    x, y = (np.array([d[p][i] for p in pairs]) for i in (0, 1))
    r = np.corrcoef(x, y)[0, 1]
    key = lambda n, p: (hashlib.md5(f"{n}|{p}|5".encode()).hexdigest()[:15], n)
    start = sorted(names, key=lambda n: key(n, 0))
    hits = 0
    for p in range(1, 41):
        to = dict(zip(sorted(names, key=lambda n: key(n, p)), start))
        moved = np.array([d[min(to[a], to[b]), max(to[a], to[b])][1] for a, b in pairs])
        hits += abs(np.corrcoef(x, moved)[0, 1]) >= abs(r)
    assert out["r"] == pytest.approx(r) and out["p_value"] == pytest.approx((hits + 1) / 41) and out["n_permutations"] == 40
    flat = listed.withColumn("x", F.lit(1.0))
    assert tuple(community.mantel_test(flat, sites, "x", "y", 5, 1).first())[:2] == (None, None)


def test_curves_against_counting(spark):
    rnd = random.Random(6)
    pairs = sorted({(f"c{int(rnd.expovariate(0.1))}", f"g{rnd.randint(1, 70)}") for _ in range(500)})
    df = spark.createDataFrame(pairs, "cluster_id string, genome string")
    genomes = sorted({g for _, g in pairs})
    key = lambda u, p: hashlib.md5(f"{u}|{p}|9".encode()).hexdigest()[:15]
    curves = []
    for p in range(5):
        place = {g: i + 1 for i, g in enumerate(sorted(genomes, key=lambda g: key(g, p)))}
        first = {}
        for c, g in pairs:
            first[c] = min(first.get(c, 10**9), place[g])
        curves.append(first)
    rows = richness.accumulation_curve(df, 5, 9, grid=12).collect()
    assert sorted(r.x for r in rows)[0] == 1 and max(r.x for r in rows) == len(genomes)
    for r in rows:
        seen = [sum(v <= r.x for v in first.values()) for first in curves]
        assert r["mean"] == pytest.approx(np.mean(seen)) and r["low"] == pytest.approx(np.percentile(seen, 2.5)) and r["high"] == pytest.approx(np.percentile(seen, 97.5))


def test_shared_genomes_from_the_rarer_member(spark):
    rnd = random.Random(7)
    hits = [(f"q{rnd.randint(0, 3)}", f"t{rnd.randint(0, 9)}", float(i)) for i in range(80)] + [("q0", "q0", 1.0), (None, "t1", 2.0)]
    links = [(f"q{rnd.randint(0, 3)}", f"g{rnd.randint(0, 30)}") for _ in range(60)] + [(f"t{rnd.randint(0, 9)}", f"g{rnd.randint(0, 30)}") for _ in range(40)] * 2
    got = enrich.shared_genome_pairs(spark.createDataFrame(hits, "query string, target string, pident double"), spark.createDataFrame(links, "target string, genome string"))
    of = {}
    for m, g in links:
        of.setdefault(m, set()).add(g)
    want = sorted((q, t, p, g) for q, t, p in hits if q != t and q for g in of.get(q, set()) & of.get(t, set()))
    assert sorted((r["query"], r["target"], r["pident"], r["genome"]) for r in got.collect()) == want


def places(rnd):
    pts = [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(60)]
    pts += [(10 + rnd.gauss(0, 0.5), 179.8 + rnd.gauss(0, 0.5)) for _ in range(70)]  # a crowd over the date line
    pts += [(89.5 + rnd.uniform(0, 0.5), rnd.uniform(-180, 180)) for _ in range(20)]
    pts += [(10.0, 20.0)] * 5
    return [(f"p{i:03d}", a, b if -180 <= b <= 180 else b - 360) for i, (a, b) in enumerate(pts)]


@pytest.mark.parametrize("max_km, per_point", [(40.0, 16), (700.0, 1), (5000.0, 0), (None, 16), (30_000.0, 16)])
def test_neighbours_within_a_radius(spark, monkeypatch, max_km, per_point):
    monkeypatch.setattr(neighbours, "PAIRS_PER_POINT", per_point)
    rows = places(random.Random(8))
    df = spark.createDataFrame([*rows, ("none", None, 1.0), ("nan", float("nan"), 1.0)], "id string, lat double, lon double")
    got = {(r.id_a, r.id_b): r.km for r in neighbours.neighbours_within(df, "id", max_km).collect()}
    want = {(a[0], b[0]): km(a[1:], b[1:]) for a in rows for b in rows if a[0] < b[0]}
    want = {k: v for k, v in want.items() if max_km is None or v <= max_km}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-3 for k in want)


@pytest.mark.parametrize("max_km, per_point", [(30.0, 0), (600.0, 1), (2500.0, 16)])
def test_linked_groups(spark, monkeypatch, max_km, per_point):
    monkeypatch.setattr(neighbours, "PAIRS_PER_POINT", per_point)
    rows = places(random.Random(9))
    got = {r["id"]: r["component"] for r in spatial.distance_groups(spark.createDataFrame(rows, "id string, lat double, lon double"), "id", max_km).collect()}
    label = {r[0]: r[0] for r in rows}
    moved = True
    while moved:
        moved = False
        for a in rows:
            for b in rows:
                if label[b[0]] < label[a[0]] and km(a[1:], b[1:]) < max_km:
                    label[a[0]], moved = label[b[0]], True
    assert got == label


def test_step_up_adjustment_and_ranks(spark):
    rnd = random.Random(10)
    ps = [rnd.choice([0.0, 1.0, 0.05, rnd.random(), rnd.random() ** 9, 1e-200, None]) for _ in range(300)]
    got = {r.i: r.q_value for r in stats.benjamini_hochberg(spark.createDataFrame(list(enumerate(ps)), "i int, p double"), "p").collect()}
    flat = [1.0 if p is None else p for p in ps]
    for i, p in enumerate(flat):
        q = min(min(1.0, v * len(flat) / sum(u <= v for u in flat)) for v in flat if v >= p)
        assert got[i] == pytest.approx(q, rel=1e-12, abs=1e-300)
    rows = [(f"k{rnd.randint(0, 10**6)}", rnd.choice([1, 1, 1, 2, 999, 1000, 1001, 1004, 123456, -3, 0])) for _ in range(200)]
    rows = sorted(set(rows))
    ranked = audit.ranked_list(spark.createDataFrame(rows, "key string, n long"), "key", "n").collect()
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [(r["key"], r["n"]) for r in sorted(ranked, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in ranked) == list(range(1, len(rows) + 1))


def test_counts_of_enriched_targets(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice(["t1", "t2", "t3", None]), *rnd.choice([(None, False, None, False), ("g1", True, "s1", True), ("g2", False, "s1", True), ("g3", True, None, False)])) for _ in range(60)]
    df = spark.createDataFrame(rows, "target_id string, genome string, genome_metadata_found boolean, sample_id string, sample_metadata_found boolean")
    distinct = lambda values: len({v for v in values if v is not None})
    want = (
        len(rows), distinct(r[0] for r in rows), distinct(r[0] for r in rows if r[1]), distinct(r[1] for r in rows),
        distinct(r[1] for r in rows if r[2]), distinct(r[3] for r in rows if r[4]),
    )
    out = enrich.enrichment_counts(df)
    assert tuple(out.first()) == want and "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    assert tuple(enrich.enrichment_counts(df.limit(0)).first()) == (0,) * 6


def test_mantel_where_a_distance_does_not_vary(spark):
    sites = spark.createDataFrame([(c,) for c in "abcd"], "site string")
    every = [(a, b) for a in "abcd" for b in "abcd" if a < b]
    listed = spark.createDataFrame([(a, b, 0.1 + 0.1 * i, 0.3) for i, (a, b) in enumerate(every)], "site_a string, site_b string, x double, y double")
    nan = float("nan")
    assert math.isnan(community.mantel_statistic(listed, sites, "x", "y", flat=nan).first()["r"])
    assert community.mantel_statistic(listed, sites, "x", "y").first()["r"] is None
    out = community.mantel_test(listed, sites, "x", "y", n_perm=9, seed=3, flat=nan).first()
    assert math.isnan(out["r"]) and out["p_value"] == 1.0 and out["n_permutations"] == 9
    # A pair that is not listed is at distance 1, so y varies now.
    fewer = listed.where("site_a <> 'a' or site_b <> 'b'")
    x, y = [1.0, *[0.1 + 0.1 * i for i in range(1, 6)]], [1.0, *[0.3] * 5]
    assert community.mantel_statistic(fewer, sites, "x", "y", flat=nan).first()["r"] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert community.mantel_statistic(listed.limit(0), sites.limit(1), "x", "y", flat=nan).first()["r"] is None


def test_pairs_without_a_common_genome_go_by_signature_and_hot_members_keep_theirs(spark, monkeypatch):
    rnd = random.Random(5)
    links = [(f"t{rnd.randrange(12)}", f"g{rnd.randrange(25)}") for _ in range(60)] + [("t0", f"g{i}") for i in range(25)] + [("t1", None)]
    hits = [(f"t{rnd.randrange(13)}", f"t{rnd.randrange(13)}", float(i)) for i in range(80)]
    held = {t: {g for u, g in links if u == t and g} for t in {f"t{i}" for i in range(13)}}
    expected = sorted((q, t, p, g) for q, t, p in hits if q != t for g in held[q] & held[t])
    for most in (0, 4, 256):
        monkeypatch.setattr(enrich, "SIGNED", most)
        got = enrich.shared_genome_pairs(spark.createDataFrame(hits, "query string, target string, pident double"), spark.createDataFrame(links, "target string, genome string"))
        assert sorted((r.query, r.target, r.pident, r.genome) for r in got.collect()) == expected
        assert "arrays_overlap" in got._jdf.queryExecution().optimizedPlan().toString()
