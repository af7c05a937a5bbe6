"""Whitening of embeddings: exact distributed covariance, float32 eigenvectors refined in higher precision."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.shared import materialize

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
LIMB = 40  # bits of a limb in which whole-number sums travel
SPACE = 1e-16  # eigenvalues below this share of the greatest, times the dimension, count as none


def grid_rows(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, x): every usable vector on the whole-number grid floor(64 * c) + 1000000.

    A vector that is null or empty, or holds a null or non-finite entry, is left out; of several lengths the commonest
    (then the greatest) is used, since vectors of another length have no place in one covariance.
    """
    entries = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    found = rows.select(F.col(id_col).alias("id"), entries.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & good)
    width = found.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("w")).first()
    usable = found.filter(F.size("v") == (width["w"] if width else 0))
    return usable.select("id", F.transform("v", lambda c: F.floor(c * SCALE) + OFFSET).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def limbs(values) -> list[pa.Array]:
    """Whole numbers as sums of three limbs, the upper ones worth 2^40 and 2^80."""
    values = [int(v) for v in values]
    mask = (1 << LIMB) - 1
    return [pa.array([v >> 2 * LIMB for v in values], pa.int64()), pa.array([v >> LIMB & mask for v in values], pa.int64()), pa.array([v & mask for v in values], pa.int64())]


def summed(parts: DataFrame) -> dict[int, int]:
    """Sums by ``k`` of numbers given in limbs; as many as the model has entries."""
    rows = parts.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("high", "middle", "low")]).collect()
    return {r["k"]: (r["high"] << 2 * LIMB) + (r["middle"] << LIMB) + r["low"] for r in rows}


LIMBS = "k int, high long, middle long, low long"


def exact_sums(fit: DataFrame) -> dict[int, int]:
    """Sum of every dimension, and under -1 the number of rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0, 0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                total = total + (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(total))], pa.int32()), *limbs([n, *total])], names=["k", "high", "middle", "low"])

    return summed(fit.select("x").mapInArrow(each, LIMBS))


def centred(x: np.ndarray, base: list[int]) -> np.ndarray:
    """x less the whole part of the mean; Python numbers where 64 bits could overflow."""
    if np.abs(x.astype(np.float64)).max(initial=0) < 2.0**61:
        return x - np.array(base, dtype=np.int64)
    return x.astype(object) - np.array(base, dtype=object)


def product(z: np.ndarray) -> np.ndarray:
    """z transposed times z without rounding: in doubles while all partial sums are below 2^53."""
    most = float(np.abs(z.astype(np.float64)).max(initial=1.0)) or 1.0
    rows = int(2.0**53 / most**2)
    if rows < 1:
        z = z.astype(object)
        return z.T @ z
    total = 0
    for at in range(0, len(z), rows):
        part = z[at : at + rows].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def exact_products(fit: DataFrame, base: list[int]) -> dict[int, int]:
    """Sums of products of two dimensions, both centred first; k counts the pairs of the upper triangle."""
    width = len(base)
    above = np.triu_indices(width)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = product(centred(matrix(batch.column(0)), base))[above]
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), *limbs(total)], names=["k", "high", "middle", "low"])

    return summed(fit.select("x").mapInArrow(each, LIMBS))


def clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Places of neighbouring ``values`` (rising) that stand no more than ``apart`` from the next."""
    return np.split(np.arange(len(values)), np.flatnonzero(np.diff(values) > apart) + 1)


def refined_eigen(a: np.ndarray, most: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and unit eigenvectors of a symmetric long-double matrix.

    Vectors in float32 are the start. With R = I - X'X and S = X'AX, one step adds X E, where e_ij is
    (s_ij + l_j r_ij) / (l_j - l_i) for eigenvalues that are further apart than the error so far, which halves the
    number of wrong digits or better. Eigenvalues that are closer form a cluster: their vectors are made orthogonal and turned by
    the eigenvectors of the shifted matrix within their own span, in which the small differences are all there is.
    """
    n = len(a)
    scale = np.abs(a).max()
    if scale == 0:
        return np.zeros(n, dtype=np.longdouble), np.eye(n, dtype=np.longdouble)
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    eye = np.eye(n, dtype=np.longdouble)
    size = np.sqrt((a * a).sum())
    least = np.inf
    for step in range(most):
        r = eye - x.T @ x
        s = x.T @ a @ x
        r, s = (r + r.T) / 2, (s + s.T) / 2  # else rounding, divided by a small gap, would cost orthogonality
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(values, kind="stable")
        values, x, r, s = values[order], x[:, order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        off = s - np.diag(values)
        apart = float(2 * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum())))
        groups = clusters(values, apart)
        of = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        gap = values[None, :] - values[:, None]
        far = of[:, None] != of[None, :]
        e = np.where(far, (s + values[None, :] * r) / np.where(far, gap, 1), 0)
        own = np.flatnonzero([len(g) == 1 for g in groups])
        single = np.concatenate([groups[k] for k in own]) if len(own) else np.array([], dtype=np.int64)
        e[single, single] = r[single, single] / 2
        turned = x + x @ e
        for g in groups:
            if len(g) > 1:
                at = np.ix_(g, g)
                gram = eye[at] - r[at]
                shift = values[g].mean()
                inner = (s[at] - shift * gram).astype(np.float64)
                half = np.linalg.inv(np.linalg.cholesky(gram.astype(np.float64)))
                inner = half @ inner @ half.T
                turn = half.T @ np.linalg.eigh((inner + inner.T) / 2)[1]
                turned[:, g] = turned[:, g] @ turn.astype(np.longdouble)
        x = turned
        if step > 1 and np.abs(r).max() < 1e-15 * n and (np.abs(e).max() < 1e-17 * n or apart > least / 2):
            break  # the last step changed nothing, or rounding keeps it from getting better
        least = min(least, apart)
    x = x @ (1.5 * eye - x.T @ x / 2)  # sub-solves are orthogonal to doubles only
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(values, kind="stable")
    return values[order] * scale, x[:, order]


@dataclass
class Whitening:
    """A fitted whitening: ``n`` fit rows; the mean is ``base`` + ``rest`` / n, both whole; components by falling variance."""

    n: int
    base: list[int]
    rest: list[int]
    values: np.ndarray  # variance along each component
    vectors: np.ndarray  # one column a component
    trace: float
    identity_error: float | None = None

    def scales(self) -> np.ndarray:
        """One over the standard deviation; NaN where a component has no variance."""
        top = self.values.max(initial=0)
        return np.array([1 / np.sqrt(v) if v > SPACE * len(self.base) * top else np.nan for v in self.values])

    def project(self, z: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows given less ``base``."""
        d = z.astype(np.float64) - np.array([r / self.n for r in self.rest])
        return (d @ self.vectors) * self.scales()

    def deviations(self, z: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S)^2, exact; null beyond 64 bits."""
        most = self.n * (float(np.abs(z.astype(np.float64)).max(initial=0)) + 1)
        if most * most * len(self.base) < 2.0**62:
            y = self.n * z - np.array(self.rest, dtype=np.int64)
            return (y * y).sum(axis=1).tolist()
        y = self.n * z.astype(object) - np.array(self.rest, dtype=object)
        return [v if v < 1 << 63 else None for v in (y * y).sum(axis=1)]


def spread(fit: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""
    k = model.vectors.shape[1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                w = model.project(centred(matrix(batch.column(0)), model.base))
                total += np.vstack([w.sum(axis=0), w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["k", "value"])

    rows = fit.select("x").mapInArrow(each, "k int, value double").groupBy("k").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((k + 1) * k)
    for r in rows:
        total[r["k"]] = r["value"]
    total = total.reshape(k + 1, k) / model.n
    error = np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k))
    return float(np.nanmax(error)) if np.isfinite(error).any() else None


def fit_whitening(grid: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct rows of ``grid`` (``grid_rows``); None without rows.

    Sums and products are whole numbers, added without rounding, so the covariance does not depend on how rows are
    dealt. Products are taken after the whole part of the mean is gone; what its fraction adds is put right exactly.
    Only the model goes through the driver: numbers by pair of dimensions, whatever the number of rows.
    """
    fit = materialize(grid.select("x").distinct(), "fit")
    sums = exact_sums(fit)
    if not sums:
        return None
    n = sums.pop(-1)
    width = len(sums)
    base = [sums[i] // n for i in range(width)]
    rest = [sums[i] - n * base[i] for i in range(width)]
    products = exact_products(fit, base)
    a = np.zeros((width, width), dtype=np.longdouble)
    for k, (i, j) in enumerate(zip(*np.triu_indices(width))):
        above, below = n * products[k] - rest[i] * rest[j], n * n
        high = above / below
        whole, part = high.as_integer_ratio()
        a[i, j] = a[j, i] = np.longdouble(high) + np.longdouble((above * part - whole * below) / (below * part))
    values, vectors = refined_eigen(a)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    model = Whitening(n, base, rest, np.maximum(values, 0).astype(np.float64), (vectors * sign).astype(np.float64), float(np.trace(a)))
    model.identity_error = spread(fit, model)
    return model


def whiten(grid: DataFrame, model: Whitening | None) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each row of ``grid`` and component.

    A component without variance has null ``whitened``; without any variance ``explained`` is null too. Repeated and
    null ids give their own rows; without a model there are none.
    """
    kind = grid.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.vectors.shape[1] if model else 0
        explained = [float(v / model.trace) if model.trace > 0 else None for v in model.values] if model else []
        for batch in batches:
            if not model or not batch.num_rows:
                continue
            z = centred(matrix(batch.column(1)), model.base)
            each_row = pa.array(np.repeat(np.arange(len(z)), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(each_row), pa.array(np.tile(np.arange(1, k + 1), len(z)), pa.int32()), pa.array([model.n] * (k * len(z)), pa.int64()),
                pa.array(model.deviations(z), pa.int64()).take(each_row), pa.array(model.project(z).ravel(), from_pandas=True),
                pa.array(explained * len(z), pa.float64()), pa.array([model.identity_error] * (k * len(z)), pa.float64()),
            ], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return grid.select("id", "x").mapInArrow(each, schema)
