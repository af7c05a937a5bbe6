import random

import pytest
from pyspark.sql import functions as F

from pelagia.operators import ecology, farthest, graph, richness


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(12)
    rows = sorted({(f"c{int(rng.expovariate(0.08))}", f"g{rng.randint(1, 80):03d}") for _ in range(600)})
    return spark.createDataFrame(rows, "cluster_id string, genome string"), rows


def test_blocks_end_at_all_clusters_and_start_at_none(spark, pairs):
    df, rows = pairs
    blocks = df.select("genome").distinct().withColumn("block", F.substring("genome", 2, 2))
    curve = {r["x"]: r for r in richness.block_accumulation_curve(df, blocks, 12, 5, grid=8).collect()}
    genomes = len({g for _, g in rows})
    assert curve[genomes]["low"] == curve[genomes]["high"] == len({c for c, _ in rows})
    means = [curve[x]["mean"] for x in sorted(curve)]
    assert means == sorted(means)


def test_block_curve_against_loops(spark, pairs):
    df, rows = pairs
    blocks = df.select("genome").distinct().withColumn("block", F.substring("genome", 2, 2))
    order = richness.permutations(blocks, "block", 3, 5).collect()
    of_block = {}
    for _, g in rows:
        of_block.setdefault(g[1:3], set()).add(g)
    clusters = {}
    for c, g in rows:
        clusters.setdefault(g, set()).add(c)
    seen_at = []
    for perm in range(3):
        total, seen, steps = 0, set(), [(0, 0)]
        for r in sorted((r for r in order if r["perm"] == perm), key=lambda r: r["position"]):
            for g in of_block[r["block"]]:
                seen |= clusters[g]
            total += len(of_block[r["block"]])
            steps.append((total, len(seen)))
        seen_at.append(steps)
    for row in richness.block_accumulation_curve(df, blocks, 3, 5, grid=6).collect():
        want = [max(n for x, n in steps if x <= row["x"]) for steps in seen_at]
        assert row["mean"] == pytest.approx(sum(want) / 3)


@pytest.mark.parametrize("parts", [1, 7])
def test_permutations_do_not_depend_on_partitioning(spark, pairs, parts):
    df, _ = pairs
    out = richness.permutations(df.repartition(parts), "genome", 4, 9).orderBy("perm", "position").collect()
    again = richness.permutations(df, "genome", 4, 9).orderBy("perm", "position").collect()
    assert out == again
    n = df.select("genome").distinct().count()
    assert [r["position"] for r in out if r["perm"] == 2] == list(range(1, n + 1))


def test_stratified_sample_quotas(spark):
    df = spark.createDataFrame([(f"s{i % 10 // 9}", i) for i in range(1000)] + [("tiny", 5000)], "stratum string, id long")
    out = {r["stratum"]: r["count"] for r in richness.stratified_sample(df, "stratum", "id", 100, 3).groupBy("stratum").count().collect()}
    assert out == {"s0": 90, "s1": 10, "tiny": 1}
    first = richness.stratified_sample(df, "stratum", "id", 100, 3).select("id").collect()
    assert sorted(first) == sorted(richness.stratified_sample(df.repartition(5), "stratum", "id", 100, 3).select("id").collect())


def test_habitat_null_is_centred_for_random_habitats(spark, pairs):
    df, _ = pairs
    facts = df.select("genome").distinct().withColumn("habitat", F.when(F.xxhash64("genome") % 2 == 0, "a").otherwise("b"))
    for row in richness.habitat_richness_null(df, facts, 80, 2, min_genomes=5).collect():
        assert 0.8 < row["ratio"] < 1.2 and row["low"] <= row["expected"] <= row["high"]


def test_farthest_pair_against_loops(spark):
    import math

    rng = random.Random(21)
    pts = [("c", f"g{i}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)]

    def km(a, b):
        p1, p2 = math.radians(a[2]), math.radians(b[2])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))

    got = farthest.farthest_km(spark.createDataFrame(pts, "cluster_id string, genome string, lat double, lon double")).first()["max_pairwise_km"]
    assert got == pytest.approx(max(km(a, b) for a in pts for b in pts), abs=1e-3)


def test_representative_rules(spark):
    df = spark.createDataFrame([("a", "x1", 5, "x9"), ("a", "x2", 7, "x9"), ("b", "y1", 3, "y1"), ("b", "y0", 3, "y1")], "g string, id string, n int, given string")
    assert {r["g"]: r["representative"] for r in graph.longest_member(df, "g", "id", "n").collect()} == {"a": "x2", "b": "y0"}
    assert {r["g"]: r["representative"] for r in graph.preferred_representative(df, "g", "id", "given").collect()} == {"a": "x1", "b": "y1"}


def test_incidence_counts_feed_the_estimate(spark, pairs):
    df, rows = pairs
    sizes = {}
    for c, _ in rows:
        sizes[c] = sizes.get(c, 0) + 1
    incidence = df.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    out = richness.chao2(incidence, F.lit(80)).first()
    assert (out["observed"], out["q1"], out["q2"]) == (len(sizes), sum(v == 1 for v in sizes.values()), sum(v == 2 for v in sizes.values()))
