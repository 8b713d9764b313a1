"""The normal distribution, which Spark's functions lack, in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Terms of the continued fraction for the tail and where it takes over from the series.
TERMS, TAIL = 60, 2.5


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function, within 1e-13: a series for the middle, a continued fraction for the tails."""
    z = np.abs(x)
    middle = np.minimum(z, TAIL)
    term, total = middle.copy(), middle.copy()
    for n in range(1, TERMS):
        term = term * 2 * middle * middle / (2 * n + 1)
        total = total + term
    inner = 2 / math.sqrt(math.pi) * np.exp(-middle * middle) * total
    far = np.minimum(np.maximum(z, TAIL), 27.0)
    below = far
    for n in range(TERMS, 0, -1):
        below = far + n / 2 / below
    outer = 1 - np.exp(-far * far) / (math.sqrt(math.pi) * below)
    return np.sign(x) * np.where(z < TAIL, inner, outer)


def _phi(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _erf(z / math.sqrt(2)))


@F.pandas_udf(DoubleType())
def cdf(x: pd.Series, mean: pd.Series, sd: pd.Series) -> pd.Series:
    """P(X <= x); null unless sd > 0."""
    good = (sd > 0) & x.notna() & mean.notna()
    z = ((x - mean) / sd).where(good, 0.0).to_numpy(float)
    return pd.Series(_phi(z), x.index).where(good)


def crps_of(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Continuous ranked probability score of normal forecasts with sd > 0."""
    z = (x - mean) / sd
    return sd * (z * (2 * _phi(z) - 1) + 2 * np.exp(-z * z / 2) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi))


@F.pandas_udf(DoubleType())
def crps(x: pd.Series, mean: pd.Series, sd: pd.Series) -> pd.Series:
    """Continuous ranked probability score of a normal forecast; null unless sd > 0."""
    good = (sd > 0) & x.notna() & mean.notna()
    score = crps_of(x.where(good, 0.0).to_numpy(float), mean.where(good, 0.0).to_numpy(float), sd.where(good, 1.0).to_numpy(float))
    return pd.Series(score, x.index).where(good)
