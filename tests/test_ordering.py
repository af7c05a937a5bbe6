import random
import statistics

import pytest
from pyspark.sql import functions as F

from pelagia.operators import ordering


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"g{i % 7}", float(rng.randint(-50, 400)) / 4, i) for i in range(3000)]
    return rows


def test_index_matches_sort_for_hot_groups(spark, skewed):
    df = spark.createDataFrame(skewed, "g string, v double, i long")
    out = ordering.ordered_index(df, ["g"], F.expr("i DIV 100"), ["i"], "idx", total="n")
    for g in {r[0] for r in skewed}:
        got = [r["idx"] for r in out.where(F.col("g") == g).orderBy("i").collect()]
        assert got == list(range(len(got)))


@pytest.mark.parametrize("parts", [1, 8])
def test_quantiles_are_exact_whatever_the_partitioning(spark, skewed, parts):
    df = spark.createDataFrame(skewed, "g string, v double, i long").repartition(parts)
    inc = {r["g"]: r for r in ordering.exact_quantiles(df, ["g"], {"v": F.col("v")}, {"p25": 0.25, "p50": 0.5, "p90": 0.9}, counts=True).collect()}
    exc = {r["g"]: r for r in ordering.exact_quantiles(df, ["g"], {"v": F.col("v")}, {"q1": 0.25, "q3": 0.75}, "exclusive").collect()}
    up = {r["g"]: r for r in ordering.exact_quantiles(df, ["g"], {"v": F.col("v")}, {"": 0.5}, "upper").collect()}
    for g in inc:
        values = sorted(v for k, v, _ in skewed if k == g)
        cuts = statistics.quantiles(values, n=100, method="inclusive")
        assert inc[g]["v_p25"] == pytest.approx(cuts[24]) and inc[g]["v_p90"] == pytest.approx(cuts[89])
        assert inc[g]["v_p50"] == pytest.approx(statistics.median(values)) and inc[g]["n_v"] == len(values)
        quart = statistics.quantiles(values, n=4)
        assert exc[g]["v_q1"] == pytest.approx(quart[0]) and exc[g]["v_q3"] == pytest.approx(quart[2])
        assert up[g]["v"] == values[len(values) // 2]


def test_single_value_and_empty_groups(spark):
    df = spark.createDataFrame([("a", 3.5), ("b", None)], "g string, v double")
    out = ordering.exact_quantiles(df, ["g"], {"v": F.col("v")}, {"min": 0.0, "p50": 0.5, "max": 1.0}).collect()
    assert [tuple(r) for r in out] == [("a", 3.5, 3.5, 3.5)]


def test_coarse_key_never_decreases(spark):
    rng = random.Random(1)
    values = sorted([0.0, 1e-9, -1e-9, 999.9999999, 1000.0, 100.0, 99.99999] + [rng.uniform(-1e6, 1e6) for _ in range(500)])
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", ordering.coarse_key(F.col("v")).alias("k"))
    keys = [r["k"] for r in sorted(df.collect(), key=lambda r: r["v"])]
    assert keys == sorted(keys)


def test_top_categories_text_skips_blanks(spark):
    df = spark.createDataFrame([("c", "x"), ("c", "x"), ("c", "y"), ("c", ""), ("c", None)], "g string, k string")
    assert ordering.top_categories_text(df, ["g"], "k", 5, "t").first()["t"] == "x (2); y (1)"
