"""Tail probabilities, applied to already aggregated rows.

Spark SQL has no error function or hypergeometric tail, so these are the only
Python functions in the package that run per value; inputs are one row per group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_erfc = np.vectorize(math.erfc, otypes=[float])
_CHUNK = 1_000_000


@F.pandas_udf(DoubleType())
def chi2_tail_1df(statistic: pd.Series) -> pd.Series:
    """P(X ≥ statistic) of a chi-square variable with one degree of freedom."""
    values = statistic.to_numpy(dtype=float, na_value=np.nan)
    out = np.full(len(values), np.nan)
    known = ~np.isnan(values)
    out[known] = _erfc(np.sqrt(np.maximum(values[known], 0.0) / 2.0))
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """Two-sided tail probability of a standard normal variable."""
    values = z.to_numpy(dtype=float, na_value=np.nan)
    out = np.full(len(values), np.nan)
    known = ~np.isnan(values)
    out[known] = _erfc(np.abs(values[known]) / math.sqrt(2.0))
    return pd.Series(out)


def log_factorial(n: np.ndarray) -> np.ndarray:
    """ln n! of whole numbers n >= 0, a whole array at once: a Stirling series at n + 10, less the ten factors above n."""
    x = n + 10.0
    series = (x + 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return series - np.log(n + np.arange(1.0, 11.0)[:, None]).sum(axis=0)


def _log_weight(k: np.ndarray, row: int, col: int, n: int) -> np.ndarray:
    return -(log_factorial(k) + log_factorial(row - k) + log_factorial(col - k) + log_factorial(n - row - col + k))


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p: total probability of tables no likelier than the observed one."""
    row, col, n = a + b, a + c, a + b + c + d
    low, high = max(0, row + col - n), min(row, col)
    if low == high:
        return 1.0
    mean = row * col / n
    spread = math.sqrt(max(row * col * (n - row) * (n - col) / (n * n * max(n - 1, 1)), 1.0))
    # Beyond forty standard deviations every term is below the smallest double.
    low, high = max(low, min(a, int(mean - 40 * spread))), min(high, max(a, int(mean + 40 * spread) + 1))
    observed = float(_log_weight(np.array([a], dtype=float), row, col, n)[0])
    peak = float(_log_weight(np.array([min(max(round(mean), low), high)], dtype=float), row, col, n)[0])
    total = extreme = 0.0
    for start in range(low, high + 1, _CHUNK):
        k = np.arange(start, min(start + _CHUNK, high + 1), dtype=float)
        logs = _log_weight(k, row, col, n)
        weights = np.exp(logs - peak)
        total += float(weights.sum())
        extreme += float(weights[logs <= observed + 1e-7].sum())
    return min(1.0, extreme / total)


@F.pandas_udf(DoubleType())
def fisher_exact_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided Fisher exact p of 2×2 counts, one table per row."""
    return pd.Series([fisher_two_sided(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d)])
