"""Whitening against exact arithmetic on small tables."""

import math
from fractions import Fraction

import numpy as np
import pytest

from pelagia.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def exact_fit(vectors):
    rows = sorted({tuple(math.floor(64 * c) + 1000000 for c in v) for v in vectors})
    n, d = len(rows), len(rows[0])
    sums = [sum(r[i] for r in rows) for i in range(d)]
    cov = [[Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in rows), n**3) for j in range(d)] for i in range(d)]
    return rows, n, sums, cov


def check(found, by_id, vectors, usual=True):
    rows, n, sums, cov = exact_fit(vectors)
    d = len(sums)
    v = np.array([[float(c) for c in r] for r in cov])
    trace = sum(cov[i][i] for i in range(d))
    values = np.linalg.eigvalsh(v)[::-1]
    k = min(16, d)
    seen = {}
    for r in found:
        assert r.n == n
        seen.setdefault(r.id, {})[r.component] = r
    for i, c in by_id.items():
        x = [math.floor(64 * e) + 1000000 for e in c]
        assert set(seen[i]) == set(range(1, k + 1))
        assert {r.deviation for r in seen[i].values()} == {sum((n * a - s) ** 2 for a, s in zip(x, sums))}
    some = next(iter(seen.values()))
    for j in range(1, k + 1):
        assert some[j].explained == pytest.approx(max(values[j - 1], 0) / float(trace), rel=1e-9, abs=1e-15)
    if usual:
        assert all(r.identity_error < 1e-9 for r in found)
        assert len({r.identity_error for r in found}) == 1
        # The whitened coordinates give the components back: their covariance with x is sqrt(e) times the eigenvector.
        ids = list(by_id)
        w = np.array([[seen[i][j].whitened for j in range(1, k + 1)] for i in ids])
        z = np.array([[math.floor(64 * e) + 1000000 - s / n for e, s in zip(by_id[i], sums)] for i in ids])
        u = np.linalg.lstsq(z, w * np.sqrt(values[:k]), rcond=None)[0]
        assert np.abs(v @ u - u * values[:k]).max() < 1e-7 * values[0]


def test_refined_eigen_reaches_double_precision():
    rnd = np.random.default_rng(1)
    for values in (np.arange(1, 21.0), np.r_[np.full(5, 2.0), 2.0 + 1e-9 * np.arange(5), np.arange(3, 13.0)], np.r_[1e6, 1 + 1e-7 * np.arange(9), np.zeros(4)], np.ones(6)):
        q = np.linalg.qr(rnd.normal(size=(len(values), len(values))))[0].astype(np.longdouble)
        for _ in range(3):  # orthogonal to long double
            q = q @ (1.5 * np.eye(len(values), dtype=np.longdouble) - q.T @ q / 2)
        a = (q * values.astype(np.longdouble)) @ q.T
        a = (a + a.T) / 2
        found, x = whitening.refined_eigen(a)
        assert np.abs(found - np.sort(values)).max() < 1e-15 * values.max() * len(values)
        assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-15
        assert np.abs(a @ x - x * found).max() < 1e-16 * values.max() * len(values)
        close = np.diff(np.sort(values))
        if close.min() > 1e-10:
            assert np.abs(np.abs(q[:, np.argsort(values)].T @ x) - np.eye(len(values))).max() < 1e-15 / (close.min() / values.max())
    assert whitening.refined_eigen(np.zeros((3, 3), dtype=np.longdouble))[0].tolist() == [0, 0, 0]


def test_products_are_exact_at_every_size():
    rnd = np.random.default_rng(2)
    for most in (3, 10**5, 2**30, 2**62):
        z = rnd.integers(-most, most, (40, 4))
        want = [[sum(int(a) * int(b) for a, b in zip(z[:, i], z[:, j])) for j in range(4)] for i in range(4)]
        assert whitening.product(z).tolist() == want


def fitted(spark, rows, schema="vec_id long, embedding array<float>, x string"):
    grid = whitening.grid_rows(spark.createDataFrame(rows, schema))
    return whitening.whiten(grid, whitening.fit_whitening(grid)).collect()


def test_whitening_with_copies_bad_vectors_and_clashes(spark):
    rnd = np.random.default_rng(3)
    vectors = [rnd.normal(size=5).astype(np.float32).tolist() for _ in range(60)]
    rows = [(i, v, "clash") for i, v in enumerate(vectors)] + [(100 + i, vectors[0], None) for i in range(500)] + [(0, vectors[0], None), (None, vectors[1], None)]
    bad = [(900, None, "a"), (901, [], "a"), (902, [1.0, None, 1.0, 1.0, 1.0], "a"), (903, [float("nan")] * 5, "a"), (904, [float("-inf")] * 5, "a"), (905, [1.0], "a")]
    found = fitted(spark, rows + bad)
    assert len(found) == 5 * len(rows)
    assert sum(r.id == 0 for r in found) == 10 and sum(r.id is None for r in found) == 5
    check([r for r in found if r.id is not None and r.id < 60], dict(enumerate(vectors)), vectors)


def test_equal_and_few_and_no_vectors(spark):
    assert fitted(spark, []) == []
    found = fitted(spark, [(i, [0.5, 2.0], None) for i in range(4)])
    assert len(found) == 8 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in found} == {(1, 0, None, None, None)}
    vectors = [[0.0, 1.0, 5.0], [1.0, 1.0, 5.0], [2.0, 1.0, 5.0]]
    found = fitted(spark, [(i, v, None) for i, v in enumerate(vectors)])
    check(found, dict(enumerate(vectors)), vectors, usual=False)
    assert {r.whitened is None for r in found if r.component > 1} == {True}
    assert sorted(abs(round(r.whitened, 12)) for r in found if r.component == 1) == [0, 1.224744871392, 1.224744871392]


def test_huge_entries_stay_exact(spark):
    vectors = [[1e17, 1.0], [-1e17, 2.0], [3e16, 9.0]]
    found = fitted(spark, [(i, v, None) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, x string")
    assert len(found) == 6 and all(r.deviation is None for r in found)
    first = sorted(abs(r.whitened) for r in found if r.component == 1)
    want = np.array([1e17, -1e17, 3e16])
    assert first == pytest.approx(sorted(np.abs((want - want.mean()) / want.std())), rel=1e-9)


def test_query_on_the_smallest_table(spark):
    found = queries.QUERIES["op12_whitening"](spark, SF)
    by_id = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(found.withColumnRenamed("vec_id", "id").collect(), by_id, list(by_id.values()))
