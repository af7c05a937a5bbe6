"""Bounded samples of labelled rows, and a ridge-penalised logistic fit for a handful of features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts))


def sample_labels(labels: DataFrame, label: str, keep: Column, most_each: int, id_col: str = "doc_id") -> DataFrame:
    """(id, y, weight) of at most ``most_each`` rows of either label, by a hash of the id; null and other labels are left out.

    ``weight`` is how many rows of the label a row stands for, so that weighted shares are those of all kept labels.
    """
    rows = labels.filter(keep & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y"))
    pick = lambda y: rows.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most_each)
    shares = rows.groupBy("y").agg(F.greatest(F.count(F.lit(1)) / F.lit(most_each), F.lit(1.0)).alias("weight"))
    return pick(1).unionByName(pick(0)).join(F.broadcast(shares), "y").select("id", "y", "weight")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30, stands_for: np.ndarray | None = None) -> np.ndarray:
    """Weights (intercept first) by Newton steps; the intercept is not penalised. A row counts ``stands_for`` times."""
    times = np.ones(len(y)) if stands_for is None else stands_for
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (times * (p - y)) + penalty * w
        curve = (x * (times * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
